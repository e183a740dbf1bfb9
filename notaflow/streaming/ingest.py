"""Incremental ingestion: each message once, whatever is delivered again and however old it is."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def new_messages(batch: DataFrame, seen: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows whose key is not in `seen`, the earliest of each key; rows without a key are told apart by all their columns."""

    def named(df: DataFrame) -> DataFrame:
        return df.withColumn("_row", F.when(F.col(key).isNull(), F.sha2(F.to_json(F.struct(*df.columns)), 256)))

    first = F.row_number().over(W.partitionBy(key, "_row").orderBy(ts))
    b, s = named(batch).withColumn("_n", first).where("_n = 1"), named(seen).select(F.col(key).alias("_key"), F.col("_row").alias("_seen"))
    return b.join(s, b[key].eqNullSafe(s["_key"]) & b["_row"].eqNullSafe(s["_seen"]), "left_anti").select(*batch.columns)


def run_once(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, key: str, ts: str) -> None:
    """Reads what is new at `source`, appends what was never ingested to `sink`, remembers the files read in `checkpoint`.

    What was ingested is what the sink holds, so a batch that runs again after a failure adds nothing twice. One run at
    a time writes to a sink; a sink and checkpoint of the former stateful query can't be continued.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    if dict(stream.dtypes)[ts] == "timestamp_ntz":
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(sink)

    def merge(batch: DataFrame, _: int) -> None:
        seen = batch.sparkSession.read.schema(batch.schema).parquet(sink)
        new_messages(batch, seen, key, ts).write.mode("append").parquet(sink)

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
