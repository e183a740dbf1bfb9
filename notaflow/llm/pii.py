"""Personal data by weak supervision.

Base spans (email, ip, card, phone) are found by fixed rules and always stay. Further candidates (person, national_id,
iban, local_phone, secret, birth_date, handle) are found by loose patterns, and five labelers vote on each: a shape labeler
(strict form or checksum), a gazetteer labeler (given names, countries, prefixes, dial codes), a context labeler (telling
words close before), a structure labeler (how the span is set off: key and sign, quotes, label and colon) and a contrary
labeler (words close by that tell of something else: versions, prices, checksums, orders).
A vote is -1, 0 or 1; 0 abstains and is no evidence. Expectation-maximisation over the counts of vote patterns of the whole
corpus estimates how reliable each labeler is for each kind when it votes for and when it votes against, and each kind's
share of true spans, held by a prior that takes a vote as right four times in five. A logistic classifier over the span's own
features (length, digits, letters, case, variety, signs, neighbours, the word before), of which the votes are none, is
trained on these posteriors; a span stays if the mean of its posterior and the classifier's probability is a half or more,
so that votes decide where the classifier has seen little. Patterns (kinds x votes x coarse features) are few, whatever the
corpus, and only their counts reach the driver.

Offsets are code points, ends exclusive. Added spans that overlap a base span, or an earlier added one, are dropped.

Defined cases: a null or empty text has no spans; very long texts are read whole, in time that grows with their length;
repeated rows each give a row; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

BASE = ("email", "ip", "card", "phone")
MORE = ("person", "national_id", "iban", "local_phone", "secret", "birth_date", "handle")
LABELERS = 5
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits starts, and ends where one ends; so no run is read twice.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Senhor", "Senhora")
NAMES = frozenset("John Mary James Anna Peter Maria Paul Laura Michael Sarah David Emma Robert Linda William Susan Richard Karen Joseph Nancy Mark Lisa George Helen Hans Klaus Jürgen Ursula Wolfgang Monika Stefan Sabine Pierre Marie Jean Claire Michel Sophie Jacques Camille José Carmen Juan Ana Luis Carlos Javier Elena Miguel Lucía João Pedro Paulo Fernanda Rafael Beatriz Thomas Julia Daniel Lucas Ahmed Fatima Wei Li Yuki Hiroshi Ivan Olga".split())
IBAN_LANDS = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
LOOSE = {
    "person": re.compile(rf"\b(?:(?:{'|'.join(TITLES)})\b\.?|[Nn]ame:|[Nn]om:|[Nn]ombre:|[Ss]igned(?: by)?:?|Dear) ([A-ZÀ-Ý][a-zà-ÿ]+(?: [A-ZÀ-Ý][a-zà-ÿ]+)?)"),
    "national_id": re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2})(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "local_phone": re.compile(r"(?<![0-9+(-])(\(?[0-9]{2,4}\)?[ -][0-9]{3,4}[ -][0-9]{4})(?![0-9-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9])([0-9A-Fa-f]{32,64}|(?:AKIA|ghp_|sk-)[A-Za-z0-9]{16,64})(?![A-Za-z0-9])"),
    "birth_date": re.compile(r"(?:[Bb]orn|[Bb]irth|DOB|[Nn]acid[oa]|[Nn]ée?|[Gg]eboren)[^\n0-9]{0,12}([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])"),
    "handle": re.compile(r"(?<![A-Za-z0-9._%+@-])(@[A-Za-z_][A-Za-z0-9_]{2,29})(?![A-Za-z0-9_.@-])"),
}
CONTEXT = {
    "person": re.compile(r"name|nom|nombre|dear|signed|contact|patient|client|mr|mrs|dr|herr|frau", re.I),
    "national_id": re.compile(r"ssn|social|security|cpf|tax|id", re.I),
    "iban": re.compile(r"iban|account|konto|compte|cuenta|bank", re.I),
    "local_phone": re.compile(r"tel|phone|call|fax|mobil|cell", re.I),
    "secret": re.compile(r"token|secret|key|passw|auth|bearer|credential", re.I),
    "birth_date": re.compile(r"born|birth|dob|nacid|geboren", re.I),
    "handle": re.compile(r"twitter|follow|handle|user|account|contact|via|insta|x\.com", re.I),
}
CONTRARY = {
    "person": re.compile(r"street|avenue|company|inc|gmbh|university|road", re.I),
    "national_id": re.compile(r"order|part|serial|isbn|version|invoice", re.I),
    "iban": re.compile(r"serial|licen[cs]e|product|order|sku", re.I),
    "local_phone": re.compile(r"order|isbn|serial|part|page|invoice|version", re.I),
    "secret": re.compile(r"commit|md5|sha|checksum|digest|hash|revision|etag|uuid", re.I),
    "birth_date": re.compile(r"order|founded|since|issued|release", re.I),
    "handle": re.compile(r"param|return|import|override|media|charset|def |class ", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ outwards, which finds what a scan from the left finds, in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def birth_ok(s: str) -> bool:
    parts = [int(x) for x in re.split("[./-]", s)]
    year, others = (parts[0], parts[1:]) if parts[0] > 31 else (parts[2], parts[:2])
    return 1900 <= year <= 2100 and 1 <= min(others) <= 12 and 1 <= max(others) <= 31


def votes_of(kind: str, span: str, before: str, after: str) -> list[int]:
    """Of the labelers for shape, gazetteer, context, structure and contrary words."""
    digits = [c for c in span if c.isdigit()]
    known = 0
    if kind == "person":
        shape, known = (1 if " " in span else 0), (1 if span.split()[0] in NAMES else -1 if len(span) < 4 else 0)
    elif kind == "national_id":
        shape, known = (1 if len(set(digits)) > 3 else -1), (-1 if span.startswith(("000", "666", "9")) and len(digits) == 9 else 0)
    elif kind == "iban":
        shape, known = (1 if iban_ok(span) else -1), (1 if span[:2] in IBAN_LANDS else -1)
    elif kind == "local_phone":
        shape, known = (1 if span.startswith("(") or "-" in span else 0), (1 if " 555" in span or "555-" in span else 0)
    elif kind == "secret":
        shape = 1 if digits and len(set(span)) > 8 else -1
        known = 1 if span.startswith(("AKIA", "ghp_", "sk-")) else 0
    elif kind == "birth_date":
        shape = 1 if birth_ok(span) else -1
    else:
        shape = 1 if any(c in span for c in "_0123456789") else 0
    context = 1 if CONTEXT[kind].search(before) else 0
    lead = before.rstrip(" ")
    set_off = 1 if lead.endswith(("=", ":", '"', "'", "(", "<")) and (not lead.endswith(('"', "'")) or after.startswith(lead[-1])) else 0
    contrary = -1 if CONTRARY[kind].search(before) or CONTRARY[kind].search(after) else 0
    return [shape, known, context, set_off, contrary]


def features_of(span: str, before: str, after: str) -> str:
    """Coarse features of a span and its neighbours, a digit each; the last one is a hash of the word before."""
    digits, letters, upper = (sum(f(c) for c in span) for f in (str.isdigit, str.isalpha, str.isupper))
    word = re.search(r"([^\W\d_]+)\W*$", before)
    own = [min(3, len(span) // 12), min(2, digits // 5), min(2, letters // 5), int(upper > 0), min(2, len(set(span)) // 7), int(not span.isalnum())]
    near = [int(before.rstrip(" ").endswith(("=", ":", '"', "'", "(", "<"))), int(after[:1].isalnum()), zlib.crc32(word[1].lower().encode()) % 8 if word else 8]
    return "".join(map(str, own + near))


def pattern_of(kind: str, span: str, before: str, after: str) -> str:
    """kind|votes|features of a candidate: what the models see of it."""
    return f"{kind}|{','.join(map(str, votes_of(kind, span, before, after)))}|{features_of(span, before, after)}"


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, pattern), in order."""
    out = []
    for kind, loose in LOOSE.items():
        for m in loose.finditer(text):
            i, j = m.span(1)
            out.append((i, j, pattern_of(kind, m[1], text[max(0, i - 24) : i], text[j : j + 12])))
    return sorted(out)


#: Names that no table has.
FOUND = ("base spans found", "candidates found")
SPANS = f"`{FOUND[0]}` array<struct<s:bigint,k:int,e:bigint>>, `{FOUND[1]}` array<struct<s:bigint,e:bigint,p:string>>"
_T = pa.list_(pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())])), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("p", pa.string())]))


def _find(batches):
    for b in batches:
        texts = [x or "" for x in b.column(b.num_columns - 1).to_pylist()]
        base = pa.array([[{"s": s, "k": k, "e": e} for s, k, e in base_spans(t)] for t in texts], _T[0])
        more = pa.array([[{"s": s, "e": e, "p": p} for s, e, p in candidates(t)] for t in texts], _T[1])
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], base, more], [*b.schema.names[:-1], *FOUND])


#: What the prior says of a vote; how many votes that counts for, and what part of those cast; true and false spans.
TRUSTED, PRIOR, ANCHOR, SHARE = 0.8, 10.0, 0.5, 2.0


def parsed(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Kind and votes of patterns."""
    kind = np.array([MORE.index(k.split("|")[0]) for k in keys], int)
    return kind, np.array([[int(v) for v in k.split("|")[1].split(",")] for k in keys], int).reshape(len(keys), LABELERS)


def estimate(counts: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], dict]:
    """Posterior of each pattern, by EM: a share of true spans per kind, and for each kind and labeler how often a span is
    true where it votes for, and false where it votes against."""
    keys = sorted(counts)
    if not keys:
        return {}, {"share": {}, "for": {}, "against": {}}
    n = np.array([counts[k] for k in keys], float)
    kind, votes = parsed(keys)
    share = np.full(len(MORE), 0.5)
    # hit[side, kind, labeler]: chance of that vote, given that it votes, on a true span (side 1) and on a false one (side 0).
    hit = np.full((2, len(MORE), LABELERS), TRUSTED)
    post = np.full(len(keys), 0.5)
    for _ in range(rounds):
        odds = np.log(share / (1 - share))[kind]
        true, false = hit[1][kind], hit[0][kind]
        odds = odds + np.where(votes > 0, np.log(true / (1 - false)), np.where(votes < 0, np.log((1 - true) / false), 0.0)).sum(1)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for side, p, right in ((1, post, votes > 0), (0, 1 - post, votes < 0)):
            for j in range(LABELERS):
                weight = n * p * (votes[:, j] != 0)
                cast = np.bincount(kind, weight, len(MORE))
                prior = PRIOR + ANCHOR * cast
                hit[side, :, j] = (np.bincount(kind, weight * right[:, j], len(MORE)) + TRUSTED * prior) / (cast + prior)
        # No labeler is worse than chance: what votes for is no evidence against.
        hit = np.maximum(hit, 0.5)
        share = (np.bincount(kind, n * post, len(MORE)) + SHARE) / (np.bincount(kind, n, len(MORE)) + 2 * SHARE)
    names = dict(zip(MORE, range(len(MORE)), strict=True))
    return dict(zip(keys, post.tolist(), strict=True)), {"share": {k: float(share[i]) for k, i in names.items()}, "for": {k: hit[1, i].tolist() for k, i in names.items()}, "against": {k: hit[0, i].tolist() for k, i in names.items()}}


def encoded(keys: list[str]) -> np.ndarray:
    """One column for every kind and every (kind, place, value) of the features that occurs."""
    cells = [[(k.split("|")[0], -1, "")] + [(k.split("|")[0], i, f) for i, f in enumerate(k.split("|")[2])] for k in keys]
    number = {c: i for i, c in enumerate(sorted({c for row in cells for c in row}))}
    x = np.zeros((len(keys), len(number)))
    for i, row in enumerate(cells):
        x[i, [number[c] for c in row]] = 1.0
    return x


def final_classifier(counts: dict[str, int], posterior: dict[str, float], rounds: int = 100) -> set[str]:
    """Patterns that are personal data by the mean of their posterior and of a logistic classifier over their features, which
    is trained on the posteriors."""
    merged: dict[str, list[float]] = {}
    for k in sorted(counts):  # patterns that differ in votes alone are one to the classifier
        kind, _, features = k.split("|")
        s = merged.setdefault(f"{kind}||{features}", [0.0, 0.0])
        s[0] += counts[k]
        s[1] += counts[k] * posterior[k]
    keys = sorted(merged)
    if not keys:
        return set()
    x, n = encoded(keys), np.array([merged[k][0] for k in keys])
    y, w = np.array([merged[k][1] for k in keys]) / n, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.eye(len(w)), x.T @ (n * (y - p)) - w)
        w += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    p = dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))
    return {k for k in counts if posterior[k] + p[f"{k.split('|')[0]}||{k.split('|')[2]}"] >= 1.0}


def chosen(base: list[dict], more: list[dict], accepted: set[str]) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind): the base ones, and accepted ones that overlap none."""
    out = [(x["s"], x["e"], BASE[x["k"]]) for x in base]
    taken, end, i = sorted((s, e) for s, e, _ in out), 0, 0
    for x in more:
        if x["p"] not in accepted or x["s"] < end:
            continue
        while i < len(taken) and taken[i][1] <= x["s"]:
            i += 1
        j = i
        while j < len(taken) and taken[j][0] < x["e"] and taken[j][1] <= x["s"]:
            j += 1
        if j < len(taken) and taken[j][0] < x["e"]:
            continue
        out.append((x["s"], x["e"], x["p"].split("|")[0]))
        end = x["e"]
    order = {k: j for j, k in enumerate(BASE + MORE)}
    return sorted(out, key=lambda t: (t[0], order[t[2]], t[1]))


def labelled(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, set[str]]:
    """The columns in `keep` with base spans and candidates of every row, stored, and the accepted patterns."""
    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [SPANS])
    found = stored(docs.select(*keep, F.col("text").alias("text to search")).mapInArrow(_find, schema), "pii-spans")
    counts = {r["p"]: r["n"] for r in found.select(F.explode(F.col(f"`{FOUND[1]}`")["p"]).alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    return found, final_classifier(counts, estimate(counts)[0])


def _report(accepted: set[str]):
    def run(batches):
        for b in batches:
            ids, base, more = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
            n = [Counter(x["k"] for x in r) for r in base]
            sha = [hashlib.sha256(",".join(f"{BASE[x['k']]}:{x['s']}:{x['e']}" for x in r).encode()).hexdigest() for r in base]
            spans = [",".join(f"{k}:{s}:{e}" for s, e, k in chosen(r, m, accepted)) for r, m in zip(base, more, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([c[k] for c in n], pa.int64()) for k in range(4)], pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def find_pii(docs: DataFrame) -> DataFrame:
    found, accepted = labelled(docs, ("doc_id",))
    return found.mapInArrow(_report(accepted), f"doc_id {dict(docs.dtypes)['doc_id']}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(text: str | None, base: list[dict], more: list[dict], accepted: set[str]) -> str | None:
    """The text with <KIND> for each span; of spans that overlap, the first."""
    if text is None:
        return None
    out, end = [], 0
    for s, e, kind in chosen(base, more, accepted):
        if s >= end:
            out += [text[end:s], f"<{kind.upper()}>"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def _mask(accepted: set[str], at: int):
    def run(batches):
        for b in batches:
            cols, text = list(b.columns[:-2]), b.column(at).to_pylist()
            cols[at] = pa.array([masked(t, x, y, accepted) for t, x, y in zip(text, b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-2])

    return run


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs with every span masked in text; other columns stay as they are."""
    keep = tuple(docs.columns)
    found, accepted = labelled(docs, keep)
    return found.mapInArrow(_mask(accepted, keep.index("text")), docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
