"""A sink that takes rows in chunks from the executors, with commit and abort.

Rows are numbered in order and cut into chunks; a chunk lies in one task, which hands it over under a key of its own. A task
that is run again hands over the same chunks under the same keys, so a sink that keeps one value a key has each once. The
driver hears of a task's chunks only by its message; when all are in, the sink's commit gets the keys, else its abort.
"""

from __future__ import annotations

import base64
import time
from dataclasses import dataclass
from typing import Protocol

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .export import in_chunks


class ChunkTarget(Protocol):
    """Where chunks go. It travels to the executors, so it must be picklable."""

    def send(self, key: str, rows: list[tuple]) -> None: ...
    def commit(self, keys: list[str]) -> None: ...
    def abort(self, keys: list[str]) -> None: ...


@dataclass
class Sent(WriterCommitMessage):
    keys: list[str]
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.target = cloudpickle.loads(base64.b64decode(options["target"]))
        self.job, self.attempts, self.wait_s, self.most_s = options["job"], int(options["attempts"]), float(options["wait_s"]), float(options["most_s"])

    def _call(self, key: str, rows: list[tuple]) -> None:
        for i in range(self.attempts):
            try:
                return self.target.send(key, rows)
            except Exception:
                if i + 1 == self.attempts:
                    raise
                time.sleep(min(self.most_s, self.wait_s * 2**i))

    def write(self, iterator) -> Sent:
        held, now, keys, n = [], None, [], 0
        for row in iterator:  # the chunk's number is the last column
            if row[-1] != now and held:
                self._call(keys[-1], held)
                held = []
            if row[-1] != now:
                now = row[-1]
                keys.append(f"{self.job}-{now}")
            held.append(tuple(row)[:-1])
            n += 1
        if held:
            self._call(keys[-1], held)
        return Sent(keys, n)

    def commit(self, messages) -> None:
        self.target.commit(sorted(k for m in messages if m for k in m.keys))

    def abort(self, messages) -> None:
        self.target.abort(sorted(k for m in messages if m for k in m.keys))


class ChunkSink(DataSource):
    """Format `chunks`; see send_from_executors."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Writer(self.options)


def send_from_executors(df: DataFrame, order: list[Column | str], target: ChunkTarget, job: str, size: int = 100, attempts: int = 5, wait_s: float = 2.0, most_s: float = 10.0) -> None:
    """Rows of df, in order, to target.send(key, rows), `size` at a time; keys are `job-number`. A call that fails is tried again after a
    pause that doubles."""
    spark = df.sparkSession
    spark.dataSource.register(ChunkSink)
    columns = [F.col(c) for c in df.columns]
    chunked = in_chunks(df.withColumn("_order", F.struct(*order)), ["_order"], size).select(*columns, "_order", "chunk")
    dealt = chunked.repartitionByRange("chunk").sortWithinPartitions("chunk", "_order").select(*columns, "chunk")
    options = {"target": base64.b64encode(cloudpickle.dumps(target)).decode(), "job": job, "attempts": attempts, "wait_s": wait_s, "most_s": most_s}
    dealt.write.format("chunks").options(**options).mode("append").save()
