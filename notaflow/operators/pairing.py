"""Pairing of notes with slips within a batch.

The grouping is a fold over documents in order and not transitive, so it runs over sorted rows, batch by batch. A
batch is one e-mail: its size is bounded by what one message can carry.
"""

from __future__ import annotations

import re
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import ids, names
from ..functions.fixed import TOLERANCE

#: Fields of a pair: the first of its notes' and then of its slips' that is there.
FIELDS = ("fornecedor_nome", "cnpj", "vencimento", "data_emissao", "empresa")
#: Pairs that leave a task at once.
CHUNK = 10_000
PAIRS = "batch_id string, pair_id string, note_number string, note_value double, slip_value double, difference double, pair_status string, note_docs array<string>, slip_docs array<string>"


def equivalent(a: str, b: str) -> bool:
    """Equal, or one ends with the other."""
    return bool(a and b) and (a == b or a.endswith(b) or b.endswith(a))


def pair_status(note: float, slip: float) -> tuple[str, float]:
    diff = round(note - slip, 2)
    if note > 0 and slip > 0:
        return ("CONCILIADO" if abs(diff) <= TOLERANCE else "DIVERGENTE"), diff
    return "CONFERIR", diff


def _groups(rows: list[dict], slip: bool) -> list[dict]:
    groups: list[dict] = []
    for r in rows:
        line = re.sub(r"\D", "", r["linha_digitavel"] or "") if slip else ""
        for g in groups:
            same = equivalent(g["number"], r["key"]) or bool(line) and line in g["lines"]
            if same or not slip and abs(g["value"] - r["valor"]) <= TOLERANCE:
                g["docs"].append(r["arquivo_origem"])
                if slip and not (line and line in g["lines"]):
                    g["value"] += r["valor"]
                if r["key"] and (not g["number"] or len(r["key"]) < len(g["number"])):
                    g["number"] = r["key"]
                g["lines"].add(line)
                break
        else:
            groups.append({"number": r["key"], "value": r["valor"], "docs": [r["arquivo_origem"]], "lines": {line}})
    return groups


def _forced(note: dict, slip: dict) -> tuple[dict, dict]:
    """The only note without an amount and the only slip, as groups."""
    return {"number": note["key"] or slip["key"], "value": 0.0, "docs": [note["arquivo_origem"]]}, {"number": slip["key"], "value": slip["valor"], "docs": [slip["arquivo_origem"]]}


def pair_batch(docs: list[dict], strict: bool = True) -> list[dict]:
    """Pairs of one batch; key is a document's normalised number. strict keeps the own pairs of notes that an aggregate covers.

    Where documents are left over and there is one note without an amount and one slip in no pair, these two are paired and
    only pairs of two amounts stay beside them."""
    rows = [d | {"valor": float(d["valor"] or 0)} for d in docs]
    notes = [r for r in rows if r["doc_type"] in ("NFSE", "DANFE", "OUTRO") and not r.get("auxiliar")]
    slips = [r for r in rows if r["doc_type"] == "BOLETO" and r["valor"] > 0]

    def made(suffix, note, slip, status=None):
        nv, sv = note["value"] if note else 0.0, slip["value"] if slip else 0.0
        got, diff = pair_status(nv, sv)
        return {"pair_id": suffix, "note_number": (note or slip or {}).get("number") or None, "note_value": nv, "slip_value": sv, "difference": diff, "pair_status": status or got, "note_docs": note["docs"] if note else [], "slip_docs": slip["docs"] if slip else []}

    if not notes and not slips:
        return [made("", None, None)]
    if len(notes) == 1 and len(slips) == 1 and notes[0]["valor"] == 0:
        return [made("", *_forced(notes[0], slips[0]), "PAREADO_FORCADO")]
    by_note, by_slip = _groups([n for n in notes if n["valor"] > 0], False), _groups(slips, True)
    used: set[int] = set()
    out, alone = [], []
    for g in by_note:
        hit = next((i for i, s in enumerate(by_slip) if i not in used and (equivalent(g["number"], s["number"]) or abs(g["value"] - s["value"]) <= TOLERANCE)), None)
        if hit is None:
            alone.append(g)
        else:
            used.add(hit)
        out.append((g, made(f"_{g['number']}" if len(by_note) > 1 and g["number"] else "", g, by_slip[hit] if hit is not None else None)))
    left = [i for i in range(len(by_slip)) if i not in used]
    pairs = [p for _, p in out]
    if len(alone) > 1 and len(left) == 1 and abs(sum(g["value"] for g in alone) - by_slip[left[0]]["value"]) <= TOLERANCE:
        whole = {"number": None, "value": sum(g["value"] for g in alone), "docs": [d for g in alone for d in g["docs"]]}
        if not strict:
            pairs = [p for g, p in out if g not in alone]
        pairs.append(made("_agregado", whole, by_slip[left[0]]))
        left = []
    pairs += [made(f"_bol{i + 1}", None, by_slip[j]) for i, j in enumerate(left)]
    zero, placed = [n for n in notes if n["valor"] == 0], {d for p in pairs for d in p["slip_docs"]}
    orphans = [s for s in slips if s["arquivo_origem"] not in placed]
    if len(zero) == 1 and len(orphans) == 1:
        pairs = [p for p in pairs if p["note_value"] > 0 and p["slip_value"] > 0] + [made("", *_forced(zero[0], orphans[0]), "PAREADO_FORCADO")]
    return pairs or [made("", None, None)]


def with_fields(pair: dict, by_file: dict[str, dict], fields: list[str]) -> dict:
    """The pair with each field's first value over its notes, then its slips."""
    docs = [by_file[d] for d in (*pair["note_docs"], *pair["slip_docs"])]
    return pair | {f: next((d[f] for d in docs if d[f] not in (None, "")), None) for f in fields}


def numbered(docs: DataFrame) -> DataFrame:
    """docs with key: a note's number, else the one in its file's name; a slip's the other way round, then the note that it names."""
    given, file = F.nullif("numero", F.lit("")), ids.number_of_file(F.col("arquivo_origem"))
    named = F.nullif("referencia_nfse", F.lit("")) if "referencia_nfse" in docs.columns else F.lit(None).cast("string")
    number = F.when(F.col("doc_type") == "BOLETO", F.coalesce(file, given, named)).otherwise(F.coalesce(given, file))
    return docs.withColumn("key", F.coalesce(ids.invoice_number(number), F.lit("")))


def _rows(part):
    """Rows of a record batch, as dictionaries."""
    names = part.schema.names
    return (dict(zip(names, row)) for row in zip(*(c.to_pylist() for c in part.columns)))


def pair_documents(docs: DataFrame, strict: bool = True) -> DataFrame:
    """Pairs of every batch of docs (batch_id, doc_seq, doc_type, arquivo_origem, numero, valor, linha_digitavel), with those of
    FIELDS that docs has; suppliers' names are cleaned. Spark deals the batches and sorts their documents; a task folds one
    batch after the other as the rows pass, so that a batch costs what its documents cost and no more than one is held."""
    fields = [f for f in FIELDS if f in docs.columns]
    kinds = dict(docs.dtypes)
    made = ", ".join([PAIRS, *(f"{f} {kinds[f]}" for f in fields)])
    schema = to_arrow_schema(StructType.fromDDL(made))

    def pairs_of(batch: str, own: list[dict]) -> list[dict]:
        by_file = {d["arquivo_origem"]: d for d in reversed(own)}
        pairs = [with_fields(p, by_file, fields) for p in pair_batch(own, strict)]
        return [p | {"batch_id": batch, "pair_id": f"{batch}{p['pair_id']}"} for p in pairs]

    def run(parts):
        out = []
        for batch, own in groupby((row for part in parts for row in _rows(part)), itemgetter("batch_id")):
            out += pairs_of(batch, list(own))
            if len(out) >= CHUNK:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    columns = [F.col("batch_id").cast("string").alias("batch_id"), "doc_seq", "doc_type", "arquivo_origem", "key", F.nanvl(F.col("valor").cast("double"), F.lit(0.0)).alias("valor"), "linha_digitavel", *fields, *(c for c in ("auxiliar",) if c in docs.columns)]
    dealt = numbered(docs).select(*columns).repartition("batch_id").sortWithinPartitions("batch_id", "doc_seq")
    out = dealt.mapInArrow(run, made)
    return out.withColumn("fornecedor_nome", F.nullif(names.entity_name(F.col("fornecedor_nome")), F.lit(""))) if "fornecedor_nome" in fields else out
