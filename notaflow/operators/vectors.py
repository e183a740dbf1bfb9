"""Brute-force vector search over chunks: squared Euclidean distance, of one query in expressions, of many in blocks."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows to one query vector, with relevance 1 / (1 + distance)."""
    d = squared_distance(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    hit = vectors.select(key, d.alias("distance")).orderBy("distance", key).limit(k)
    return hit.withColumn("relevance", 1 / (1 + F.col("distance")))


def nearest_all(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block_rows: int = 4096, chunk_rows: int = 1024) -> DataFrame:
    """query_id, rank, key, distance: the k nearest rows to each query row of the same length, ties by key.

    Rows without a vector or a key, or with a component that is null or not finite, take no part; a repeated query row counts once.
    """

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        x = df.where(F.col(key).isNotNull() & (F.size(v) > 0)).select(F.col(key).cast("bigint").alias("id"), v.alias("v"), F.size(v).alias("dim"))
        return x.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))

    rows, asked = usable(vectors), usable(queries).distinct()
    blocks, chunks = max(1, -(-rows.count() // block_rows)), max(1, -(-asked.count() // chunk_rows))
    place = F.xxhash64("id", "v")
    rows = rows.select("dim", F.pmod(place, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))).alias("chunk"), "id", "v")
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), F.pmod(place, F.lit(chunks)).alias("chunk"), "id", "v", place.alias("of"))

    def pick(r: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "of": [], "id": [], "distance": []})]
        if len(r) and len(a):
            data, ids = np.stack(r.v.to_numpy()), r.id.to_numpy()
            for q, of, v in zip(a.id, a.of, a.v, strict=True):
                d = ((data - v) ** 2).sum(axis=1)
                at = np.lexsort((ids, d))[:k]
                out.append(pd.DataFrame({"query_id": q, "of": of, "id": ids[at], "distance": d[at]}))
        return pd.concat(out[1:] or out)

    cell = ("dim", "block", "chunk")
    hit = rows.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInPandas(pick, "query_id bigint, of bigint, id bigint, distance double")
    rank = F.row_number().over(W.partitionBy("query_id", "of").orderBy("distance", "id"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "distance")
