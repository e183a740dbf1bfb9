"""Session settings every entry point shares."""

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(master)
        .appName("notaflow")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where it is unset. On a cluster
    the latter must not be a folder of the driver's own machine."""
    got = spark.conf.get("spark.checkpoint.dir", "")
    if not got:
        got = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/notaflow-shared"
        where = spark._jvm.org.apache.hadoop.fs.Path(got)
        local = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getUri().getScheme() == "file"
        if local and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share; the warehouse is a local one")
    return got.rstrip("/")
