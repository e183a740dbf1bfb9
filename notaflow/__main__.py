"""Command line.

    python -m notaflow queries                         names of the registered queries
    python -m notaflow run NAME --input DIR [--out DIR] a query, shown or written as Parquet
    python -m notaflow route TEXTS --out DIR            extractor, type and subtype of text files
    python -m notaflow ingest SOURCE SINK --key K --ts T --state DIR   what is new at SOURCE, each message once
    python -m notaflow export DOCS --out DIR            a documents CSV to ledger, tabs and one CSV a type
    python -m notaflow report BATCHES                   summary of an exported batches CSV
    python -m notaflow cleanup DIR --hours 48           batches older than that (listed, never deleted)
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .operators import export, layouts, quality, router, runs
from .plans import catalog
from .session import session
from .sources import tables
from .streaming.ingest import run_once


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="notaflow", description=__doc__.splitlines()[0])
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries")
    for name, places in (("run", ("name",)), ("route", ("texts",)), ("ingest", ("source", "sink")), ("export", ("documents",)), ("report", ("batches",)), ("cleanup", ("folder",))):
        s = sub.add_parser(name)
        for place in places:
            s.add_argument(place)
        s.add_argument("--out")
    s = sub.choices["run"]
    s.add_argument("--input", required=True)
    s = sub.choices["ingest"]
    for option in ("--key", "--ts", "--state"):
        s.add_argument(option, required=True)
    sub.choices["export"].add_argument("--without-number", action="store_true")
    sub.choices["cleanup"].add_argument("--hours", type=int, default=48)
    return p


def written(df, out: str | None) -> None:
    if out:
        df.write.mode("overwrite").parquet(out)
    else:
        df.show(50, truncate=False)


def main(argv: list[str]) -> int:
    a = parser().parse_args(argv)
    if a.command == "queries":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if a.command == "run" and a.name not in catalog.QUERIES:
        print(f"no query {a.name}", file=sys.stderr)
        return 2
    spark = session(a.master)
    if a.command == "run":
        written(catalog.QUERIES[a.name](spark, a.input), a.out)
    elif a.command == "route":
        written(router.routed(tables.whole_texts(spark, a.texts)).drop("text"), a.out)
    elif a.command == "ingest":
        run_once(spark, a.source, spark.read.parquet(a.source).schema, a.sink, a.state, a.key, a.ts)
    elif a.command == "export":
        docs = tables.documents_csv(spark, a.documents)
        out = a.out or "out"
        export.write_csv(layouts.paf_rows(docs, a.without_number), f"{out}/paf")
        export.write_csv(layouts.anexos_rows(docs.where("doc_type <> 'AVISO'")), f"{out}/anexos")
        export.write_csv(layouts.sem_anexos_rows(docs.where("doc_type = 'AVISO'")), f"{out}/sem_anexos")
        export.write_csv(docs, f"{out}/por_tipo", "doc_type")
    elif a.command == "report":
        b = tables.health_csv(spark, a.batches)
        print(runs.as_text(quality.summary(b, "valor_compra", "fornecedor", "vencimento"), "Resumo executivo"))
        print(runs.as_text(runs.shares(b, "status_conciliacao"), "Situação"))
    elif a.command == "cleanup":
        old = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.folder).where(F.col("modificationTime") < F.current_timestamp() - F.make_dt_interval(hours=F.lit(a.hours)))
        written(old.select(F.regexp_replace("path", "/[^/]*$", "").alias("batch")).distinct(), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
