"""N-gram Jaccard join by PartEnum signatures.

A set's features are its distinct word-shingle hashes. Sets are compared in size bands; each
band partitions the feature domain by a hash into parts. A signature stands for a subset of
the parts: (band, the parts, the set's features in them).

Why no link is lost. Linked sets of sizes a <= b with similarity of 4/5 at least differ in at
most (a + b) / 9 features, which is at most K(n) = n / 4 for either size n. Each difference
spoils at most one part, so of a set's N non-empty parts at least N - K are shared. Parts
that are empty in both would also agree, but nothing rests on them. In any order of the
parts that both sets follow, the first K + m of each then have m parts in common, if there
are that many.

- Bands up to ENUMERATED features: every two of the first K + 2 parts are a signature. A set
  with fewer than K + 2 parts also gives signatures of one part.
- Bands above: a subset is one part, as enumerating larger ones takes K^2 / 2 signatures or
  more. The parts are taken rarest first, by document frequency, and the first K + 1 are
  candidates' signatures; a set with more than K signatures of its own has none, and common
  passages come last.
- Sets with no more than K parts in a band also give signatures of single features, of which
  there are n > K, by the same order.

Sets that differ in size up to the similarity may be in neighbouring bands, so a set that is
large enough also gives the next band's signatures.

Signatures travel as arrays, one row for many, to ranges of the signature's hash, where they
are counted. The most frequent are known from a sample of documents; they are not gathered
in a range, and come last in the order. That changes where they are handled, never a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qscope.llm.common import BROADCAST_ROWS, Scratch, as_long, copies_of, give_back, keyed, lean, mix, number_rows, only, packed, shingle_sets, shingle_slices, stream, unpacked
from qscope.llm.components import components

WORDS = 5
#: Similarity as a fraction: 100 * both >= PERCENT * either.
PERCENT = 80
#: Bands end at FIRST * RATIO^i features; a part holds up to PER_PART features on average.
FIRST, RATIO, PER_PART, MIN_PARTS = 8, 3, 3.5, 16
#: The largest sets whose signatures are of two parts, and the parts of their bands.
ENUMERATED, SMALL_PARTS = 24, 64
SINGLE = 63
SALTS = stream(21, 64)
#: Signatures sent at once, and in a range.
SENT, RANGE = 1 << 19, 1 << 18
#: Documents in which frequent signatures are looked for: LOOKED_AT to twice as many, or one
#: in LEAST_SHARE where that is more; and how many of all documents make one frequent. So the
#: driver holds at most one of 512 of the sample's signatures.
LOOKED_AT, LEAST_SHARE, HOT_SETS = 8192, 2048, 1 << 20
LAST = 1 << 60
#: Sets in a block, and about how many features they have; patterns that are compared at
#: once; the most owners of a pattern whose pairs are listed, and pairs listed at once.
BLOCK, FEATURES, COLUMNS, LISTED, PAIRS = 1024, 1 << 19, 4096, 6, 1 << 19
#: Pairs with one hub in a task's group, and pairs of sets that go to a worker at once.
HUB_PAIRS, PAIR_ROWS = 1024, 256


def bands(n: int) -> list[int]:
    """The bands in which a set of n features gives signatures."""
    i, top = 0, FIRST
    while n > top:
        i, top = i + 1, top * RATIO
    return [i, i + 1] if 100 * n >= PERCENT * (top + 1) else [i]


def allowed(n: int) -> int:
    """The most features in which a linked set can differ, whichever is larger."""
    return n // 4


def _top(band: int) -> int:
    return FIRST * RATIO**band


def _marked(out: np.ndarray, band: int) -> np.ndarray:
    """Signatures with the band as their low six bits."""
    return (out & ~np.uint64(63)) | np.uint64(band)


def _parts(features: np.ndarray, counts: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of the non-empty parts, how many each set has) of sets whose features
    follow each other, counts[i] of set i."""
    parts = SMALL_PARTS if _top(band) <= ENUMERATED else max(MIN_PARTS, int(_top(band) / PER_PART))
    h = mix(features ^ SALTS[band])
    cell = np.repeat(np.arange(len(counts)) * parts, counts) + (h >> np.uint64(32)).astype(np.int64) % parts
    h = mix(h)
    size = len(counts) * parts
    # Sums of 32-bit halves are exact in doubles; they wrap as 64-bit sums do.
    low = np.bincount(cell, (h & np.uint64(0xFFFFFFFF)).astype(float), size).astype(np.uint64)
    high = np.bincount(cell, (h >> np.uint64(32)).astype(float), size).astype(np.uint64)
    held = np.flatnonzero(np.bincount(cell, minlength=size))
    sums = low[held] + (high[held] << np.uint64(32))
    out = mix(sums + (held % parts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _marked(out, band), np.bincount(held // parts, minlength=len(counts))


def _pairs_of(parts: np.ndarray, n: int, band: int) -> np.ndarray:
    """The signatures of every two of a set's first K + 2 parts; of single parts as well
    where there are fewer."""
    need = allowed(n) + 2
    first = np.sort(parts)[:need]
    i, j = np.triu_indices(len(first), 1)
    out = _marked(mix(first[i] + mix(first[j])), band)
    return np.unique(out if len(parts) >= need else np.concatenate([out, parts]))


class Signed:
    """Signatures of some sets: set, signature; and per set and band (set, band, how many of
    its signatures are candidates, how many it has)."""

    def __init__(self):
        self.sets: list[np.ndarray] = []
        self.signatures: list[np.ndarray] = []
        self.totals: list[np.ndarray] = []

    def add(self, sets: np.ndarray, counts: np.ndarray, signatures: np.ndarray, band: int, need: np.ndarray) -> None:
        self.sets.append(np.repeat(sets, counts))
        self.signatures.append(signatures)
        self.totals.append(np.stack([sets, np.full(len(sets), band), need, counts], 1))


def sign(sets: np.ndarray, counts: np.ndarray, features: np.ndarray) -> Signed:
    """The signatures of sets whose features follow each other."""
    out = Signed()
    some = counts > 0
    sets, counts = sets[some], counts[some]
    begin = np.cumsum(counts) - counts
    # More than _top(i) features: band i + 1 at least.
    tops = np.array([_top(i) for i in range(40)])
    low = np.searchsorted(tops, counts)
    high = low + (100 * counts >= PERCENT * (tops[low] + 1))
    scarce = np.zeros(len(sets), bool)
    for band in np.union1d(low, high).tolist():
        at = np.flatnonzero((low == band) | (high == band))
        n = counts[at]
        chosen = np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        parts, held = _parts(features[chosen], n, band)
        if _top(band) <= ENUMERATED:
            lists = [_pairs_of(p, int(m), band) for p, m in zip(np.split(parts, np.cumsum(held)[:-1]), n, strict=True)]
            held_pairs = np.array([len(x) for x in lists])
            out.add(sets[at], held_pairs, np.concatenate(lists), band, held_pairs)
        else:
            out.add(sets[at], held, parts, band, n // 4 + 1)
        scarce[at] |= held <= n // 4
    at = np.flatnonzero(scarce)
    if len(at):
        n = counts[at]
        chosen = np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out.add(sets[at], n, _marked(mix(features[chosen] ^ SALTS[SINGLE]), SINGLE), SINGLE, n // 4 + 1)
    return out


def enumerate_signatures(features: np.ndarray) -> list[np.ndarray]:
    """A set's signatures, an array for each band."""
    return [s for s in sign(np.zeros(1, np.int64), np.array([len(features)]), features).signatures if len(s)]


# ---------------------------------------------------------------- counting signatures


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, c): signatures of a slice of texts, and how many sets have them."""
    for batch in batches:
        for a, counts, features in shingle_slices(batch.column(0), WORDS):
            found = sign(np.arange(a, a + len(counts)), counts, features).signatures
            if found:
                keys, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(keys)), pa.array(times)], names=["sig", "c"])


def frequent(docs: DataFrame, n: int, hot_sets: int = HOT_SETS) -> tuple[np.ndarray, int]:
    """(sorted signatures that are frequent, about how many signatures docs(k, text) has)."""
    every = max(1, min(LEAST_SHARE, n // LOOKED_AT))
    seen = docs.where(F.expr(f"pmod(xxhash64(k), {every}) = 0")).select("text").mapInArrow(lean(_look), "sig long, c long")
    summed = seen.groupBy("sig").agg(F.sum("c").alias("c"))
    found = summed.agg(F.sum("c"), F.collect_list(F.when(F.col("c") >= max(2, hot_sets // every), F.col("sig")))).first()
    return np.sort(np.array(found[1], np.int64).view(np.uint64)), (found[0] or 0) * every


SENT_COLUMNS = "r int, kind int, a binary, b binary"
COLD, HOT, TOTALS, SIZES = 0, 1, 2, 3


def _range(sig: np.ndarray, ranges: int) -> np.ndarray:
    return ((sig >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _send(shared, ranges: int):
    """mapInArrow: (k, text) to arrays of signatures and their sets by range; frequent
    signatures and totals go to ranges in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        held: list[Signed] = []
        sizes: list[np.ndarray] = []
        size, turn = 0, 0

        def rows() -> list[tuple]:
            nonlocal turn
            nothing = np.zeros(0, np.uint64)
            sig = np.concatenate([nothing, *[s for h in held for s in h.signatures]])
            k = np.concatenate([nothing.view(np.int64), *[s for h in held for s in h.sets]])
            at = np.minimum(np.searchsorted(hot, sig), max(0, len(hot) - 1))
            often = hot[at] == sig if len(hot) else np.zeros(len(sig), bool)
            turn += 1
            out = [((turn * 7919) % ranges, TOTALS, np.concatenate([np.zeros((0, 4), np.int64), *[t for h in held for t in h.totals]]).tobytes(), b"")]
            out.append(((turn * 7919 + 2) % ranges, SIZES, np.concatenate(sizes).tobytes(), b""))
            if often.any():
                out.append(((turn * 7919 + 1) % ranges, HOT, sig[often].tobytes(), k[often].tobytes()))
            sig, k = sig[~often], k[~often]
            r = _range(sig, ranges)
            order = np.argsort(r.astype(np.uint16) if ranges < 1 << 16 else r, kind="stable")
            sig, k = sig[order], k[order]
            edges = np.searchsorted(r[order], np.arange(ranges + 1))
            for i in np.flatnonzero(np.diff(edges)).tolist():
                x, y = edges[i], edges[i + 1]
                out.append((i, COLD, sig[x:y].tobytes(), packed(k[x:y])))
            return out

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, counts, features in shingle_slices(batch.column(1), WORDS):
                held.append(sign(ids[a : a + len(counts)], counts, features))
                sizes.append(np.stack([ids[a : a + len(counts)], counts], 1).astype(np.int64))
                size += len(counts) + sum(len(s) for s in held[-1].signatures)
                if size >= SENT:
                    yield _sent(rows())
                    held, sizes, size = [], [], 0
        if size:
            yield _sent(rows())

    return run


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["r", "kind", "a", "b"])


COUNTED = "k long, band int, sig long, f long, need long, total long"


def _rows(k, band, sig, f, need, total) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.nulls(len(k), t) if c is None else pa.array(c, t) for c, t in zip((k, band, sig, f, need, total), kinds, strict=True)], names=[c.split()[0] for c in COUNTED.split(", ")])


def _count(table: pa.Table) -> pa.Table:
    """A range's rows to its signatures of two sets or more, with their frequency, and to
    the totals and sizes (band -1) that came along."""
    out = []
    for kind in (COLD, HOT, TOTALS, SIZES):
        part = table.filter(pc.equal(table.column("kind"), kind))
        a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
        if not a:
            continue
        if kind == TOTALS:
            rows = np.frombuffer(b"".join(a), np.int64).reshape(-1, 4)
            out.append(_rows(rows[:, 0], rows[:, 1].astype(np.int32), None, None, rows[:, 2], rows[:, 3]))
            continue
        if kind == SIZES:
            rows = np.frombuffer(b"".join(a), np.int64).reshape(-1, 2)
            out.append(_rows(rows[:, 0], np.full(len(rows), -1, np.int32), None, None, rows[:, 1], None))
            continue
        sig = np.frombuffer(b"".join(a), np.uint64)
        k = np.frombuffer(b"".join(b), np.int64) if kind == HOT else np.concatenate([unpacked(y, len(x) // 8) for x, y in zip(a, b, strict=True)])
        f = np.full(len(sig), LAST)
        if kind == COLD:
            order = np.argsort(sig)
            sig, k = sig[order], k[order]
            first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            f = np.repeat(np.diff(np.append(first, len(sig))), np.diff(np.append(first, len(sig))))
            often = f > 1
            sig, k, f = sig[often], k[often], f[often]
        out.append(_rows(k, (sig & np.uint64(63)).astype(np.int32), as_long(sig), f, None, None))
    return pa.concat_tables(out) if out else _rows(*[np.zeros(0, np.int64)] * 6)


def candidates(docs: DataFrame, scratch: Scratch, hot_sets: int = HOT_SETS) -> tuple[DataFrame, DataFrame]:
    """((sig, k): for each set of docs(k, text), distinct texts, its candidate signatures that
    another set shares; (k, n): every set's size)."""
    hot, total = frequent(docs, docs.count(), hot_sets)
    ranges = max(1, -(-total // RANGE))
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    sent = docs.select("k", "text").mapInArrow(lean(_send(shared, ranges)), SENT_COLUMNS)
    counted = scratch.table(sent.groupBy("r").applyInArrow(_count, COUNTED))
    totals = counted.where("band >= 0 AND sig IS NULL").select("k", "band", "need", "total")
    mine = counted.where("sig IS NOT NULL").select("k", "band", "sig", "f")
    # Signatures of its own come first in a set's order; what is left of the prefix is shared.
    left = mine.groupBy("k", "band").agg(F.count("*").alias("m")).join(totals, ["k", "band"]).select("k", "band", F.expr("need - (total - m)").alias("left")).where("left > 0")
    left = scratch.table(left)
    first = Window.partitionBy("k", "band").orderBy("f", "sig")
    some = only(mine, left.select("k", "band"), ["k", "band"], "left_semi")
    out = some.join(left, ["k", "band"]).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= F.col("left"))
    made = scratch.table(out.select("sig", "k"))
    sizes = scratch.table(counted.where("band = -1").select("k", F.col("need").alias("n")))
    scratch.drop(counted, left)
    return made, sizes


# ---------------------------------------------------------------- comparing sets


def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, text) to (k, s): the sorted features as bytes."""
    for batch in batches:
        ids, out, size = batch.column(0).to_pylist(), [], 0
        for i, s in shingle_sets(batch.column(1), WORDS):
            out.append((ids[i], s.astype("<u8").tobytes()))
            size += 8 * len(s)
            if size > 1 << 22:
                yield _contents(out)
                out, size = [], 0
        yield _contents(out)


def _contents(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["k", "s"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            u, v = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            if len(u) > len(v):
                u, v = v, u
            if 100 * len(u) < PERCENT * len(v):
                continue
            at = np.searchsorted(v, u)
            both = int((v[np.minimum(at, len(v) - 1)] == u).sum())
            keep[i] = 100 * both >= PERCENT * (len(u) + len(v) - both)
        chosen = np.flatnonzero(keep)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(chosen)), batch.column(1).take(pa.array(chosen))], names=["a", "b"])


def verify(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets. Pairs with one a are dealt out
    by b, HUB_PAIRS or so in a group."""
    ids = scratch.table(pairs.select(F.col("a").alias("k")).unionAll(pairs.select(F.col("b").alias("k"))).distinct())
    sets = scratch.table(only(docs.select("k", "text"), ids, "k", "left_semi").mapInArrow(lean(contents), "k long, s binary"), "none")
    groups = pairs.groupBy("a").agg((F.expr(f"count(*) div {HUB_PAIRS}") + 1).alias("groups"))
    left = groups.join(sets, F.col("a") == F.col("k")).select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), "groups", F.col("s").alias("x"))
    right = pairs.join(sets, F.col("b") == F.col("k")).select("a", "b", F.col("s").alias("y"))
    numbers = groups.withColumnRenamed("a", "_a")
    numbers = F.broadcast(numbers.where("groups > 1")) if groups.where("groups > 1").count() <= BROADCAST_ROWS else numbers.where("groups > 1")
    right = right.join(numbers, F.col("a") == F.col("_a"), "left").withColumn("g", F.expr("coalesce(pmod(xxhash64(b), groups), 0)")).drop("_a", "groups")
    out = scratch.table(right.join(left.drop("groups"), ["a", "g"]).select("a", "b", "x", "y").mapInArrow(lean(_linked), "a long, b long"), rows=PAIR_ROWS)
    scratch.drop(ids, sets)
    return out


def _matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, which are linked) between two blocks of sets, or within one, sorted by
    block and k. Features with the same owners are one pattern with a weight. Patterns of a
    few owners are counted pair by pair, the others by products of 0/1 matrices."""
    block = rows["block"].to_numpy()
    sets = [np.frombuffer(s, "<u8") for s in rows["s"]]
    n = len(sets)
    size = np.array([len(s) for s in sets])
    features = np.concatenate(sets)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    order = np.argsort(features, kind="stable")
    features, owner = features[order], owner[order]
    del order, sets
    edge = np.flatnonzero(np.append(True, features[1:] != features[:-1]))
    times = np.diff(np.append(edge, len(features)))
    edge, times = edge[times > 1], times[times > 1]
    del features
    # Whole numbers up to 2^24 are exact in single precision.
    kind = np.float32 if size.max() < 1 << 23 else np.float64
    both = np.zeros((n, n), kind)
    if len(edge):
        marks = np.concatenate([[0], np.cumsum(mix(np.arange(1, n + 1, dtype=np.uint64) ^ SALTS[2])[owner], dtype=np.uint64)])
        _, first, weight = np.unique(marks[edge + times] - marks[edge], return_index=True, return_counts=True)
        edge, times = edge[first], times[first]
        few = times <= LISTED
        for t in range(2, LISTED + 1):
            some, used = edge[times == t], weight[times == t].astype(float)
            i, j = np.triu_indices(t, 1)
            step = PAIRS // len(i)
            for c in range(0, len(some), step):
                owners = owner[some[c : c + step, None] + np.arange(t)].astype(np.int64)
                listed = np.bincount((owners[:, i] * n + owners[:, j]).ravel(), np.repeat(used[c : c + step], len(i)), n * n).reshape(n, n)
                both += listed
                both += listed.T
        edge, times, weight = edge[~few], times[~few], weight[~few]
        for c in range(0, len(edge), COLUMNS):
            e, t = edge[c : c + COLUMNS], times[c : c + COLUMNS]
            m = np.zeros((n, len(e)), kind)
            m[owner[np.repeat(e - (np.cumsum(t) - t), t) + np.arange(int(t.sum()))], np.repeat(np.arange(len(e)), t)] = 1
            both += (m * weight[c : c + COLUMNS].astype(kind)) @ m.T
    left, right = np.flatnonzero(block == block[0]), np.flatnonzero(block == block[-1])
    both = both[left[0] : left[-1] + 1, right[0] : right[-1] + 1].astype(np.int64)
    either = size[left][:, None] + size[right][None] - both
    linked = 100 * both >= PERCENT * either
    if block[0] == block[-1]:
        np.fill_diagonal(linked, True)
    return left, right, linked


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """The linked pairs between two blocks of sets, or within one, that are in different
    components."""
    rows = rows.sort_values(["block", "k"])
    block, k, comp = (rows[c].to_numpy() for c in ("block", "k", "comp"))
    left, right, ok = _matrix(rows)
    ok &= comp[left][:, None] != comp[right][None]
    if block[0] == block[-1]:
        ok &= k[left][:, None] < k[right][None]
    x, y = np.nonzero(ok)
    x, y = k[left][x], k[right][y]
    del ok
    give_back()
    return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def _degrees(rows: pd.DataFrame) -> pd.DataFrame:
    """(k, n): with how many documents a set links, between two blocks or within one; comp
    is the number of documents with the set."""
    rows = rows.sort_values(["block", "k"])
    block, k, weight = (rows[c].to_numpy() for c in ("block", "k", "comp"))
    left, right, ok = _matrix(rows)
    if block[0] == block[-1]:
        np.fill_diagonal(ok, False)
        return pd.DataFrame({"k": k[left], "n": ok @ weight[right]})
    return pd.DataFrame({"k": np.concatenate([k[left], k[right]]), "n": np.concatenate([ok @ weight[right], ok.T @ weight[left]])})


def compare_blocks(open_: DataFrame, docs: DataFrame, scratch: Scratch, compare=_compare, schema: str = "a long, b long") -> DataFrame:
    """Links (a, b) between different components among open_(sig, k, comp): all sets that
    share a bucket are compared, in blocks of at most BLOCK sets and about FEATURES features,
    of which those meet that share a bucket, each two once. Sets of like size and neighbours
    in a bucket are numbered together, so few blocks do. A block's sets are of one class of
    sizes, a power of four; classes that differ by more than one can't link."""
    sizes = scratch.table(only(docs.select("k", "text"), open_.select("k").distinct(), "k", "left_semi").mapInArrow(lean(contents), "k long, s binary"), "none")
    hub = open_.groupBy("sig").agg(F.min("k").alias("hub"))
    mine = open_.join(hub, "sig").groupBy("k").agg(F.min("hub").alias("hub"), F.min("comp").alias("comp"))
    sized = mine.join(sizes.select("k", F.expr("cast(floor(log2(greatest(length(s) div 8, 1)) / 2) as int)").alias("class")), "k")
    numbered = number_rows(sized, ["class", "hub", "k"], scratch)
    most = f"greatest(1, least({BLOCK}, {FEATURES} div cast(pow(4, class + 1) as bigint)))"
    placed = scratch.table(numbered.select("k", "comp", "class", F.expr(f"(_rn div {most}) * 64 + class").alias("block")))
    touched = scratch.table(open_.select("sig", "k").join(placed.select("k", "block"), "k").select("sig", "block").distinct())
    # Of the buckets that touch the same blocks, one stands for all.
    alike = touched.groupBy("sig").agg(F.expr("bit_xor(xxhash64(block))").alias("x"), F.expr("bit_xor(xxhash64(block, 1))").alias("y"), F.count("*").alias("c"))
    chosen = alike.groupBy("x", "y", "c").agg(F.min("sig").alias("sig")).select("sig")
    some = only(touched, scratch.table(chosen), "sig", "left_semi")
    meet = some.select("sig", F.col("block").alias("i")).join(some.select("sig", F.col("block").alias("j")), "sig").where("i <= j AND abs(pmod(i, 64) - pmod(j, 64)) <= 1").select("i", "j").distinct()
    meet = scratch.table(meet)
    sets = scratch.table(sizes.join(placed, "k").select("k", "comp", "block", "s"), "none")
    scratch.drop(sizes, touched)
    dealt = sets.join(meet.withColumn("block", F.col("i")), "block").unionByName(sets.join(meet.where("i < j").withColumn("block", F.col("j")), "block"))
    out = scratch.table(dealt.groupBy("i", "j").applyInPandas(compare, schema))
    scratch.drop(sets, meet)
    return out


# ---------------------------------------------------------------- the join


def beside(df: DataFrame, side: DataFrame, key: str, many: str) -> DataFrame:
    """df joined with side(key, many, ...), which is broadcast if its counted size allows;
    otherwise its keys that many rows of df have are spread over HUB_PAIRS rows or so each."""
    if side.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(side), key)
    groups = F.expr(f"{many} div {HUB_PAIRS} + 1")
    spread = side.withColumn("_g", F.explode(F.sequence(F.lit(0), groups - 1)))
    hot = side.where(groups > 1).select(key, groups.alias("_n"))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot.hint("shuffle_hash")
    return df.join(hot, key, "left").withColumn("_g", F.expr("coalesce(pmod(xxhash64(k), _n), 0)")).drop("_n").join(spread, [key, "_g"]).drop("_g")


def join(docs: DataFrame, scratch: Scratch | None = None, links_too: bool = True, hot_sets: int = HOT_SETS) -> DataFrame:
    """(k, doc_id, n_shingles, component, component_id, n_links) for every row of docs; no
    n_links without links_too.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a document's set is its distinct 5-word
    shingles, with fewer words the whole sequence as one; null and wordless texts have empty
    sets and link with nothing. Two documents link when 100 * both >= 80 * either. component
    is the least k reachable by links, n_links the number of other documents that the
    document links with, those of an equal set included. Rows that repeat a doc_id, or have none, are
    documents of their own. Texts of any length are taken whole; which of several equally
    frequent signatures comes first, and which least k a bucket is compared with, changes no
    link. An empty table gives no rows; extra columns are ignored.

    Equal texts meet first and go on as one. A bucket's sets are then compared with its least
    one; what this leaves in different components is compared in blocks, so no linked pair
    is left out, and no join emits the pairs of a group. For n_links all sets that share a
    bucket are compared in blocks, which give numbers only. A signature of hot_sets documents
    or more, by the sample, is not counted in one place; that changes no link."""
    scratch = scratch or Scratch(docs.sparkSession)
    d = keyed(docs, scratch)
    of, copies = copies_of(d, scratch)
    reps = only(d.select("k", "text"), of.where("k != rep").select("k"), "k", "left_anti")
    found, sizes = candidates(reps, scratch, hot_sets)
    of = of.join(sizes.withColumnRenamed("k", "rep"), "rep")
    hubs = scratch.table(found.groupBy("sig").agg(F.min("k").alias("a"), F.count("*").alias("f")).where("f > 1"))
    pairs = scratch.table(beside(found, hubs, "sig", "f").where("a != k").select("a", F.col("k").alias("b")).distinct())
    links = verify(pairs, reps, scratch)
    labels = components(links, scratch)
    # What is left: sets in one bucket but not yet in one component.
    placed = scratch.table(found.join(labels, "k", "left").select("sig", "k", F.coalesce("comp", "k").alias("comp")))
    mixed = scratch.table(placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("f")).where("lo != hi").select("sig", "f"))
    open_ = scratch.table(beside(placed, mixed, "sig", "f").select("sig", "k", "comp"))
    if open_.limit(1).count():
        found_more = compare_blocks(open_, reps, scratch)
        if found_more.limit(1).count():
            links = scratch.table(links.unionAll(found_more))
            labels = components(links, scratch)
    names = d.select("k", "doc_id")
    out = of.join(labels.select(F.col("k").alias("rep"), "comp"), "rep", "left")
    more = []
    if links_too:
        size = copies.withColumnRenamed("rep", "k")
        weighed = found.join(size, "k", "left").select("sig", "k", F.coalesce("c", F.lit(1)).alias("comp"))
        degree = compare_blocks(weighed, reps, scratch, _degrees, "k long, n long").groupBy(F.col("k").alias("rep")).agg(F.sum("n").alias("others"))
        out = out.join(copies, "rep", "left").join(degree, "rep", "left")
        out = out.withColumn("n_links", F.when(F.col("n") > 0, F.coalesce("others", F.lit(0)) + F.coalesce("c", F.lit(1)) - 1).otherwise(0))
        more = ["n_links"]
    out = out.select("k", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("comp", "rep")).otherwise(F.col("k")).alias("component"), *more)
    if not d._renumbered:
        return out.select("k", F.col("k").alias("doc_id"), "n_shingles", "component", F.col("component").alias("component_id"), *more)
    out = out.join(names, "k").join(names.select(F.col("k").alias("component"), F.col("doc_id").alias("component_id")), "component")
    return out.select("k", "doc_id", "n_shingles", "component", "component_id", *more)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that link, directly or not, to one with a smaller doc_id;
    one row of each group stays, and all rows with no shingles. Where doc_ids repeat or are
    null, the first row by (doc_id, text) of a group stays, nulls first. Long texts are taken
    whole. Columns may have any names; an empty table gives no rows."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.table(join(docs, scratch, links_too=False).select("k", "doc_id", "component"))
    gone = found.where("k != component")
    again = found.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    if not again:
        return only(docs, gone.select("doc_id"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    # Rows are told apart by their text as well, equal rows by a count.
    d = keyed(docs, scratch)
    stay = d.join(gone.select("k"), "k", "left_anti").groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    ranked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.xxhash64("row"))))
    same = ranked["doc_id"].eqNullSafe(stay["doc_id"]) & ranked["text"].eqNullSafe(stay["text"]) & (ranked["nth"] <= stay["n"])
    return ranked.join(stay, same, "left_semi").select("row.*")
