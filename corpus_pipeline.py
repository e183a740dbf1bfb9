"""A training corpus from documents, in five stages of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and
reads back as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notaflow.llm import jaccard, mixing, pii, quality, segmentation
from notaflow.llm.common import stored, table

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject.

    A null or empty text is scored as one empty line; rows without an id are scored too; repeated rows are kept or rejected
    alike; very long texts are scored whole; without labels every document stays; no rows give no rows; of other columns none
    is kept, whatever their names."""
    return quality.classify(docs, table(spark, sf_dir, "labels"), keep=DOCUMENT).where("predicted = 1").select(*DOCUMENT)


def row_key():
    """A row's own key, whatever its id: rows that share it have one id and one text, so they are copies."""
    return F.xxhash64("doc_id", "text")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, Jaccard 0.8 and more); one without an
    id stays where its group has no other, and texts that share an id are told apart.

    Null, empty and blank texts have no shingles and are copies of nothing; a repeated row (id and text) stays once; very long
    texts are compared whole; no rows give no rows; of other columns none is kept."""
    keyed = docs.select(*DOCUMENT, row_key().alias("key"))
    groups = jaccard.similar_groups(keyed.select(F.col("key").alias("doc_id"), "text"), words=5, percent=80)
    groups = groups.select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = keyed.select("key", "doc_id").distinct().join(groups, "key")
    first = ids.groupBy("component_id").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("key"))
    # A repeated row has one key and stays once.
    return keyed.join(first.select("key"), "key", "left_semi").dropDuplicates(["key"]).select(*DOCUMENT)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in the text.

    A null text stays null, with a null n_chars; empty texts stay; repeated rows are masked alike and stay as often; very long
    texts are masked whole; no rows give no rows; of other columns none is kept."""
    out = pii.redact(docs.select(*DOCUMENT))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*DOCUMENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times.

    Texts without words are never taken; a null source is one of its own; repeated rows share what they take; a very long text
    is taken whole; no rows give no rows; of other columns none is kept."""
    keyed = docs.select(*DOCUMENT, row_key().alias("key"))
    taken = mixing.weighted_mix(keyed.select(F.col("key").alias("doc_id"), "text", "source")).where("taken > 0")
    # Masking may have made rows of one id alike: their copies add up on one of them.
    taken = taken.groupBy(F.col("doc_id").alias("key")).agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("copies"))
    keyed = keyed.dropDuplicates(["key"])
    return keyed.join(taken, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*DOCUMENT)


def segmentation_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document.

    A null or empty text has the empty one; rows with one id draw alike for one text, and repeated rows each give theirs; very
    long texts are segmented whole; no rows give no rows; columns other than id, language and source are left out."""
    return segmentation.sample_segmentations(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("segmentation", segmentation_stage),
]

#: The classifier and the sampled segmentations can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
