"""Streaming statistics over restarts, and the counters' bound."""

import collections
import random

from pyspark.sql import functions as F

from notaflow.streaming import statistics


def test_space_saving_bounds_its_error():
    rng = random.Random(1)
    mails = [f"s{int(rng.paretovariate(0.9))}" for _ in range(5000)]
    counters, true = {}, collections.Counter(mails)
    for m in mails:
        statistics.counted(counters, m, 50)
    assert len(counters) == 50 and all(0 <= n - true[s] <= e for s, (n, e) in counters.items())
    assert {s for s, n in true.items() if n > len(mails) / 50} <= set(counters)


def test_statistics_over_two_restarts(spark, tmp_path):
    rows = [(("nf", "boleto")[i % 2], f"a{i % 7}@x" if i % 5 else None, f"subject {i:03}", i) for i in range(90)]
    schema, seen = "kind string, sender string, subject string, at bigint", {}
    for part in range(3):
        spark.createDataFrame(rows[30 * part : 30 * part + 30], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

        def keep(df, batch):
            seen.update({r.kind: r for r in df.collect()})

        query = statistics.inbox_statistics(stream, samples=4, counters=20).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()
        done = rows[: 30 * part + 30]
        for kind in ("nf", "boleto"):
            own = [r for r in done if r[0] == kind]
            assert seen[kind].n == len(own) and seen[kind].samples == [r[2] for r in own[:4]]
            want = collections.Counter(r[1] for r in own if r[1])
            assert {s.sender: s.n for s in seen[kind].senders} == dict(want) and all(s.error == 0 for s in seen[kind].senders)
    assert spark.range(1).select(F.lit(1)).count() == 1
