"""Sampled SentencePiece segmentations without replacement, and decoding.

A text becomes one lattice: nodes are places between characters, edges are vocabulary pieces (a character with no piece
of its own has one edge of its byte pieces). Pieces never cross from a character into a following space, so the lattice
is a chain of lattices of units (a run of spaces and the run of other characters after it), and equal units share one.
Each edge weighs exp(alpha * log prior), the prior falling with the piece's rank in the vocabulary (Zipf); backward sums
over the lattice make that a distribution over all segmentations.

Gumbel top-k: every segmentation has a perturbed log-probability, log p + Gumbel noise; the k largest are a sample of k
without replacement. A-star search finds them without listing segmentations: a set of segmentations with a common
prefix has a known maximum law, so the frontier holds such sets, each with its perturbed maximum (an exact bound). The
best set is opened: its best member is drawn piece by piece, and every piece's alternatives form new sets, whose maxima
are drawn below the member's. The (k+1)th value is the threshold for the inclusion probabilities, which are given as
logarithms: a long text's are far below the smallest double.

Noise is a hash of the row key, the draw and the place, so a row's result does not depend on its neighbours, partition
or attempt.

Defined cases: a null or empty text has one segmentation, the empty one; a text with fewer than k segmentations gives
all of them; a very long text is segmented whole, by units between blanks, in time and memory in proportion to its length;
repeated rows with one key give equal results; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .shingles import STEP, mixed

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
BREAK = "\x00"
TABLE_BITS = 19
ALL = 2**64 - 1
GROW, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Vocabulary:
    """Pieces of a SentencePiece model with byte fallback: log prior, spelled bytes, and a matcher for all of them."""

    def __init__(self, path: str, alpha: float):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        byte = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in byte.items()}
        usable = [i for i in range(n) if i not in byte and not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        assert not any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in usable)
        self.length = np.zeros(n, np.int64)
        self.logp = np.full(n, -alpha * np.log(n + 10.0))
        for rank, i in enumerate(usable):
            self.length[i], self.logp[i] = len(self.pieces[i]), -alpha * np.log(rank + 10.0)
        self.longest = int(self.length.max())
        # Open addressing, a slot and the ones after it: all pieces and their beginnings, by number in `known`.
        begins: dict[str, int] = {}
        for i in usable:
            for size in range(1, len(self.pieces[i])):
                begins.setdefault(self.pieces[i][:size], -1)
        for i in usable:
            begins[self.pieces[i]] = i
        self.known = np.array(list(begins.values()), np.int32)
        known_length = np.array([len(x) for x in begins], np.int64)
        self.known_hash = np.zeros(len(begins), np.uint64)
        names = list(begins)
        with np.errstate(over="ignore"):
            for size in range(1, self.longest + 1):
                own = np.flatnonzero(known_length == size)
                chars = np.frombuffer("".join(names[i] for i in own).encode("utf-32-le"), np.uint32).reshape(len(own), size)
                for column in chars.T:
                    self.known_hash[own] = self.known_hash[own] * GROW + column.astype(np.uint64) + np.uint64(1)
        self.table, self.probes = np.full((1 << TABLE_BITS) + 64, -1, np.int32), 1
        table = self.table.tolist()
        for i, slot in enumerate(slots(self.known_hash).tolist()):
            at = slot
            while table[at] >= 0:
                at += 1
            table[at], self.probes = i, max(self.probes, at - slot + 1)
        self.table[:] = table
        self.known_length = known_length
        self.single = {self.pieces[i] for i in usable if len(self.pieces[i]) == 1}
        self.spelled = [bytes([byte[i]]) if i in byte else self.pieces[i].replace(SPACE, " ").encode() if self.length[i] else b"" for i in range(n)]
        self.size = np.array([len(x) for x in self.spelled], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.spelled), np.uint8)


def slots(h: np.ndarray) -> np.ndarray:
    return ((h * SPREAD) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def matches(v: Vocabulary, chars: np.ndarray, to_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and id of every piece in the units: a rolling hash of each length, looked up for all places at once. A place is
    left when no piece begins with what stands there."""
    at = np.flatnonzero(to_end > 0)
    h = np.zeros(len(at), np.uint64)
    starts, pieces = [], []
    for size in range(1, v.longest + 1):
        go = to_end[at] >= size
        at, h = at[go], h[go]
        if not len(at):
            break
        h = h * GROW + chars[at + size - 1] + np.uint64(1)
        slot, todo, found = slots(h), np.arange(len(at)), np.full(len(at), -1, np.int32)
        for probe in range(v.probes):
            entry = v.table[slot + probe]
            hit = (v.known_hash[entry] == h[todo]) & (entry >= 0)
            found[todo[hit]] = entry[hit]
            on = ~hit & (entry >= 0)
            slot, todo = slot[on], todo[on]
            if not len(todo):
                break
        some = found >= 0
        at, h, found = at[some], h[some], found[some]
        piece = v.known[found]
        whole = (piece >= 0) & (v.known_length[found] == size)
        starts.append(at[whole])
        pieces.append(piece[whole].astype(np.int64))
    # Longer pieces first: they are the likelier ones, so a draw looks at few.
    return (np.concatenate(starts[::-1]), np.concatenate(pieces[::-1])) if starts else (np.zeros(0, np.int64),) * 2


@lru_cache(2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


def prepared(text: str | None) -> str:
    """A leading space, and spaces as marks; the empty text stays empty."""
    return SPACE + text.replace(" ", SPACE).replace(BREAK, "�") if text else ""


def units_in(text: str | None) -> list[str]:
    """A text's units in order; a mark that is in the text already counts as a space, as in the library."""
    if not text:
        return []
    words = text.split(" ")
    if "" in words or SPACE in text or BREAK in text:
        return UNIT.findall(prepared(text))
    return [SPACE + w for w in words]


def decode(v: Vocabulary, ids) -> str:
    """The text of pieces: the leading space that encoding adds is taken off."""
    return b"".join([v.spelled[i] for i in ids]).decode("utf-8", "replace")[1:]


class Lattice:
    """Lattices of distinct units, side by side: node = place in the joined units."""

    def __init__(self, v: Vocabulary, units: list[str]):
        joined = BREAK.join(units) + BREAK
        lens = np.array([len(u) for u in units], np.int64)
        self.first = np.cumsum(lens + 1) - lens - 1
        to_end = np.repeat(self.first + lens, lens + 1) - np.arange(len(joined)) if units else np.zeros(1, np.int64)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        with np.errstate(over="ignore"):
            start, piece = matches(v, chars, to_end)
        end, score = start + v.length[piece], v.logp[piece]
        # Characters without a piece: an edge of byte pieces, named by -1 - (index of its list).
        self.spelt: list[list[int]] = []
        names = {c: None for c in set(joined) - v.single - {BREAK}}
        for c in names:
            names[c] = len(self.spelt)
            self.spelt.append([v.byte_id[b] for b in c.encode("utf-8", "surrogatepass")])
        if names:
            odd = [(m.start(), names[m[0]]) for m in re.finditer(f"[{re.escape(''.join(names))}]", joined)]
            at, which = np.array(odd, np.int64).T
            cost = np.array([len(s) for s in self.spelt])[which] * v.logp[v.byte_id[0]]
            start, end = np.concatenate([start, at]), np.concatenate([end, at + 1])
            piece, score = np.concatenate([piece, -1 - which]), np.concatenate([score, cost])
        order = np.argsort(start, kind="stable")
        start, end, piece, score = start[order], end[order], piece[order], score[order]
        beta, steps, longest = np.zeros(len(joined)), to_end[start], int(lens.max(initial=0))
        order = np.argsort(steps.astype(np.int16) if longest < 2**15 else steps, kind="stable")
        cuts = np.searchsorted(steps[order], np.arange(1, longest + 2))
        # All places that are so far from their unit's end. Plain sums as long as no double is too small for them, then logs.
        worst = float((-score / (end - start)).max(initial=1e-9))
        plain, weight, plenty = max(1, int(650 // worst)), np.exp(score), np.ones(len(joined))
        for step, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), 1):
            if a < b:
                own = order[a:b]
                from_, to = start[own], end[own]
                heads = np.flatnonzero(np.diff(from_, prepend=-1))
                if step <= plain:
                    plenty[from_[heads]] = sums = np.add.reduceat(weight[own] * plenty[to], heads)
                    beta[from_[heads]] = np.log(sums)
                else:
                    beta[from_[heads]] = np.logaddexp.reduceat(score[own] + beta[to], heads)
        self.start, self.end, self.piece = start, end, piece
        self.logp = np.minimum(0.0, score + beta[end] - beta[start])
        heads = np.flatnonzero(np.diff(start, prepend=-1))
        self.begin = np.zeros(len(joined) + 1, np.int64)
        self.begin[1:] = np.cumsum(np.bincount(start, minlength=len(joined)))
        p = np.exp(self.logp)
        cum = np.cumsum(p)
        self.upto = cum - np.repeat(cum[heads] - p[heads], np.diff(heads, append=len(p)))
        self.upto[np.append(heads[1:], len(p))[: len(heads)] - 1] = np.inf
        self.last = to_end <= 0

    def draw(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each node, by probability."""
        e = self.begin[nodes]
        on = np.flatnonzero(u >= self.upto[e])
        while len(on):
            e[on] += 1
            on = on[u[on] >= self.upto[e[on]]]
        return e


def uniform(seed: np.ndarray, draw: int, at: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1), a hash of all arguments."""
    with np.errstate(over="ignore"):
        x = mixed(seed + at.astype(np.uint64) * STEP[0] + np.uint64((draw * STEP[1].item() + step * STEP[2].item()) & ALL))
    return ((x >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def one(seed: int, draw: int, at: int) -> float:
    """uniform() of one place."""
    a, b, _, c = (int(s) for s in STEP)
    x = (seed + at * a + draw * b) & ALL
    x = (x ^ (x >> 32)) * c & ALL
    x = (x ^ (x >> 29)) * b & ALL
    return (((x ^ (x >> 32)) >> 12) + 0.5) / 2.0**52


def paths(lat: Lattice, seeds: list[np.uint64], starts: list[tuple[np.ndarray, np.ndarray]], draw: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row's (nodes, numbers of their units): drawn edges from each node to the end of its unit, and their units."""
    sizes = [len(n) for n, _ in starts]
    row = np.repeat(np.arange(len(starts)), sizes)
    seed = np.array(seeds, np.uint64)[row]
    nodes, at = (np.concatenate([x[i] for x in starts]).astype(np.int64) if starts else np.zeros(0, np.int64) for i in (0, 1))
    edges, units, place, step, where = [], [], [], 0, np.arange(len(row))
    while len(nodes):
        e = lat.draw(nodes, uniform(seed, draw, at, step))
        edges.append(e)
        units.append(at)
        place.append(where)
        nodes = lat.end[e]
        go = ~lat.last[nodes]
        nodes, at, seed, where, step = nodes[go], at[go], seed[go], where[go], step + 1
    if not edges:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in starts]
    place = np.concatenate(place)
    order = np.argsort(place, kind="stable")
    e, u, r = np.concatenate(edges)[order], np.concatenate(units)[order], row[place[order]]
    cuts = np.searchsorted(r, np.arange(1, len(starts)))
    return list(zip(np.split(e, cuts), np.split(u, cuts), strict=True))


def log1mexp(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)) for x <= 0."""
    x = np.minimum(x, 0.0)
    with np.errstate(divide="ignore"):
        return np.where(x > -0.7, np.log(-np.expm1(x)), np.log1p(-np.exp(x)))


def below(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel draws with these locations, given that they are below top."""
    g = location - np.log(-np.log(u))
    return -np.logaddexp(-top, -g)


def log1mexp_one(x: float) -> float:
    x = min(x, 0.0)
    if x == 0.0:
        return -math.inf
    return math.log(-math.expm1(x)) if x > -0.7 else math.log1p(-math.exp(x))


def below_one(location: float, top: float, u: float) -> float:
    g = location - math.log(-math.log(u))
    low, high = sorted((-top, -g))
    return -(high + math.log1p(math.exp(low - high)))


def log_inclusion(logp: float, threshold: float) -> float:
    """Log of the probability that a segmentation's perturbed log p exceeds the threshold; 0 without one."""
    x = logp - threshold
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


class Search:
    """The A-star search for one row: its found segmentations and its frontier of sets."""

    def __init__(self, lat: Lattice, nodes: np.ndarray, seed: np.uint64, k: int):
        self.lat, self.nodes, self.seed, self.k = lat, nodes, int(seed), k
        self.value = -math.log(-math.log(one(self.seed, 0, -1)))
        self.found: list[tuple[np.ndarray, float, float]] = []
        self.sets: list[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]] = []
        self.stem, self.shut, self.head, self.over, self.location = 0, np.zeros(0, np.int64), None, -np.inf, 0.0

    def begin(self) -> tuple[np.ndarray, np.ndarray]:
        return self.nodes, np.arange(len(self.nodes))

    def path(self, edges: np.ndarray, units: np.ndarray) -> None:
        """The drawn rest of a path, put behind what it has in common with the path it left."""
        if self.head is not None:
            edges, units = np.concatenate([self.head[0], edges]), np.concatenate([self.head[1], units])
        self.edges, self.units = edges, units

    def last_turn(self, logp: float) -> None:
        """Takes the last path. Of the sets that leave it only the greatest maximum counts, and they are all of the set it was
        drawn from but itself; so one draw does for them."""
        self.found.append((self.edges, logp, self.value))
        rest = self.location + log1mexp_one(logp - self.location)
        tops = [float(x[3].max()) for x in self.sets]
        if math.isfinite(rest):
            tops.append(below_one(rest, self.value, one(self.seed, 3000, self.k)))
        self.over = max(tops, default=-np.inf)

    def turn(self, prefix: np.ndarray, bound: np.ndarray, location: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Takes the path with the bounds of the sets that leave it; gives where the next path has to be drawn from."""
        lat, draw = self.lat, len(self.found) + 1
        self.found.append((self.edges, float(prefix[-1]) if len(prefix) else 0.0, self.value))
        if len(bound):
            self.sets.append((self.edges, self.units, self.stem, bound, self.shut, location))
        tops = [float(x[3].max()) for x in self.sets]
        if not tops or not np.isfinite(max(tops)):
            self.over = -np.inf
            return None
        self.over = max(tops)
        edges, units, stem, bound, shut, location = self.sets[int(np.argmax(tops))]
        i = int(np.argmax(bound))
        bound[i], self.location = -np.inf, float(location[i])
        step = stem + i
        shut = np.append(shut if i == 0 else np.zeros(0, np.int64), edges[step])
        node, unit = lat.start[edges[step]], units[step]
        closed = set(shut.tolist())
        choice = np.array([c for c in range(lat.begin[node], lat.begin[node + 1]) if c not in closed])
        p = np.cumsum(np.exp(lat.logp[choice] - lat.logp[choice].max()))
        turn = choice[min(int(np.searchsorted(p, p[-1] * one(self.seed, 2000 + draw, step), "right")), len(choice) - 1)]
        self.head = np.append(edges[:step], turn), np.append(units[:step], unit)
        self.stem, self.shut, self.value = step, shut, self.over
        nodes, numbers = self.nodes[unit + 1 :], np.arange(unit + 1, len(self.nodes))
        if not lat.last[lat.end[turn]]:
            nodes, numbers = np.append(lat.end[turn], nodes), np.append(unit, numbers)
        return nodes, numbers

    def result(self) -> list[tuple[np.ndarray, float, float, float]]:
        return [(e, lp, g, log_inclusion(lp, self.over)) for e, lp, g in self.found]


def leaving(lat: Lattice, rows: list[Search], draw: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each row's path: log p up to and with each step, and from the stem on the perturbed maximum and the log p of the
    set that leaves it at each step. All rows in one go; a row's numbers hang on the row alone."""
    sizes = np.array([len(s.edges) for s in rows])
    every = np.concatenate([s.edges for s in rows]).astype(np.int64)
    lp = lat.logp[every]
    cuts = np.cumsum(sizes)[:-1]
    prefix = [np.cumsum(x) for x in np.split(lp, cuts)]
    row = np.repeat(np.arange(len(rows)), sizes)
    place = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    stem = np.array([s.stem for s in rows])
    on = place >= stem[row]
    row, place, lp, flat = row[on], place[on], lp[on], np.concatenate(prefix)[on] - lp[on] if len(rows) else lp
    node = lat.start[every[on]]
    out = lat.begin[node + 1] - lat.begin[node]
    rest, some = log1mexp(lp), out > 1
    counts = np.maximum(0, sizes - stem)
    begin = np.cumsum(counts) - counts
    for i, s in enumerate(rows):
        if len(s.shut) and counts[i]:  # alternatives that are other sets' are not this set's
            j = begin[i]
            gone = np.exp(lat.logp[np.append(s.shut, s.edges[s.stem])]).sum()
            some[j] = len(s.shut) + 1 < out[j] and gone < 1 - 1e-12
            rest[j] = np.log1p(-gone) if some[j] else -np.inf
    some &= np.isfinite(rest)
    location, bound = flat + rest, np.full(len(row), -np.inf)
    at = row[some]
    u = uniform(np.array([s.seed for s in rows], np.uint64)[at], 1000 + draw, place[some], 0)
    bound[some] = below(location[some], np.array([s.value for s in rows])[at], u)
    cuts = np.cumsum(counts)[:-1]
    return prefix, np.split(bound, cuts), np.split(location, cuts)


def samples(lat: Lattice, rows: list[np.ndarray], seeds: list[np.uint64], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each row (first nodes of its units): (edges, log p, perturbed log p, log inclusion probability) of k distinct
    segmentations, best first. All rows advance together."""
    every = [Search(lat, nodes, seed, k) for nodes, seed in zip(rows, seeds, strict=True)]
    now, todo, draw = every, [s.begin() for s in every], 1
    while now:
        for s, drawn in zip(now, paths(lat, [s.seed for s in now], todo, draw), strict=True):
            s.path(*drawn)
        if draw == k:
            for s in now:
                s.last_turn(float(lat.logp[s.edges].sum()))
            break
        more = [(s, s.turn(*x)) for s, *x in zip(now, *leaving(lat, now, draw), strict=True)]
        now, todo, draw = [s for s, t in more if t is not None], [t for _, t in more if t is not None], draw + 1
    return [s.result() for s in every]


def ids_of(lat: Lattice, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of edges, bytes of characters without a piece spelled out; and the edge each comes from."""
    ids, of = lat.piece[edges], np.arange(len(edges))
    odd = ids < 0
    if odd.any():
        size = np.ones(len(ids), np.int64)
        size[odd] = [len(lat.spelt[-1 - i]) for i in ids[odd]]
        of, at = np.repeat(of, size), np.cumsum(size) - size
        out = ids[of]
        for i in np.flatnonzero(odd):
            out[at[i] : at[i] + size[i]] = lat.spelt[-1 - ids[i]]
        ids = out
    return ids, of


def spelled_alike(v: Vocabulary, ids: np.ndarray, text: bytes) -> bool:
    """Whether decoding the ids gives these bytes."""
    size = v.size[ids]
    if size.sum() != len(text):
        return False
    at = np.repeat(v.begin[ids] - (np.cumsum(size) - size), size) + np.arange(len(text))
    return bool((v.bytes[at] == np.frombuffer(text, np.uint8)).all())


def _sampler(path: str, k: int, alpha: float):
    def run(batches):
        v = vocabulary(path, alpha)
        for b in batches:
            if not b.num_rows:
                continue
            units_of = [units_in(t) for t in b.column(b.num_columns - 1).to_pylist()]
            flat_units = list(chain.from_iterable(units_of))
            distinct = list(dict.fromkeys(flat_units))
            number = dict(zip(distinct, range(len(distinct)), strict=True))
            lat = Lattice(v, distinct)
            first = lat.first[np.fromiter(map(number.__getitem__, flat_units), np.int64, len(flat_units))]
            nodes = np.split(first, np.cumsum([len(u) for u in units_of])[:-1])
            seeds = b.column(0).to_numpy().view(np.uint64)
            results = samples(lat, nodes, list(seeds), k)
            texts = ["".join(u).replace(SPACE, " ").encode("utf-8", "surrogatepass") for u in units_of]
            many = [len(r) for r in results]
            flat = [x for r in results for x in r]
            ids, of = ids_of(lat, np.concatenate([e for e, *_ in flat]) if flat else np.zeros(0, np.int64))
            ends = np.searchsorted(of, np.cumsum([len(e) for e, *_ in flat]))
            whole = "".join([t.decode("utf-8", "surrogatepass") * m for t, m in zip(texts, many, strict=True)]).encode("utf-8", "surrogatepass")
            # One comparison for the batch; row by row only where it fails.
            ok = [True] * len(many)
            if not spelled_alike(v, ids, whole):
                cuts = np.split(ids, ends[:-1]) if len(ends) else []
                each = iter(cuts)
                ok = [all([spelled_alike(v, next(each), t) for _ in range(m)]) for t, m in zip(texts, many, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
            parts = pa.StructArray.from_arrays([lists, *[pa.array([x[i] for x in flat], pa.float64()) for i in (1, 2, 3)]], ["ids", "logp", "gumbel", "log_inclusion"])
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([*b.columns[1:-1], out, pa.array(ok, pa.bool_())], [*b.schema.names[1:-1], "samples", "round_trip"])

    return run


def sample_segmentations(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), key: str = "doc_id", k: int = 2, alpha: float = 1.0, model: str = "") -> DataFrame:
    """The columns in `keep`, samples (best first) and round_trip (every sample decodes to the text) of each row."""
    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", samples array<struct<ids:array<int>,logp:double,gumbel:double,log_inclusion:double>>, round_trip boolean"
    rows = docs.select(F.xxhash64(key).alias("seed of row"), *keep, F.col("text").alias("text to cut"))
    return rows.mapInArrow(_sampler(model or public_tokenizers.path(MODEL), k, alpha), schema)


def op9_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"))
