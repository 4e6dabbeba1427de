"""Cross-entropy difference: matched target and background n-gram models over one vocabulary.

Both models interpolate bigrams, unigrams and a uniform floor, have the same vocabulary and
differ only in the text they were counted on. A document's score is its mean per-token loss
under the background model less that under the target model: above 0 where the target
explains it better.

Words and bigrams are counted by their whole 64-bit hashes, in as many key ranges as the
input asks for. A document is scored without its own counts, so a key that only one document
has counts nothing, and only keys of two documents or more go back to the documents. Keys
that are frequent in some documents are summed in the tasks and broadcast; which keys those
are changes what is sent, never a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qscope.llm.common import BROADCAST_ROWS, SHINGLE_MULTIPLIERS, SLICE_BYTES, Scratch, as_long, free, keyed, mix, slices, text_bytes, word_hashes

#: Weights of bigram, unigram and uniform estimates.
LAMBDAS = (0.6, 0.35, 0.05)
#: Documents in which frequent keys are looked for, how many of them make a key frequent, and
#: the most such words, and bigrams, that are broadcast.
LOOKED_AT, FREQUENT, HOT = 4096, 3, 1 << 18
#: Tokens for each range of keys, and documents for each group that is scored at once.
RANGE_TOKENS, GROUP_DOCS = 1 << 20, 1024

COUNTED = "bucket int, hot boolean, keys binary, g binary, n binary"
SUMMED = "g int, pair boolean, keys binary, t binary, b binary, words long, tokens_t long, tokens_b long"


def features(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bigram hashes, which words begin one)."""
    if len(words) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p = mix(words[:-1] * SHINGLE_MULTIPLIERS[0] + words[1:] * SHINGLE_MULTIPLIERS[1])
    at = np.flatnonzero(owner[:-1] == owner[1:])
    return p[at], at


def distinct(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (key, owner) by key: keys, owners, how often, and each entry's place.
    Owners ascend."""
    order = np.argsort(keys, kind="stable")
    u, o = keys[order], owner[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    place = np.empty(len(u), np.int64)
    place[order] = np.cumsum(new) - 1
    return u[first], o[first], np.diff(np.append(first, len(u))), place


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in a sorted table, which keys are there)."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each range of sorted keys begins, and the end."""
    return np.searchsorted(((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def group_of(k: np.ndarray, groups: int) -> np.ndarray:
    return np.mod(k ^ (k >> 16), groups)


def _kinds(data: np.ndarray, off: np.ndarray, a: int, b: int) -> list[tuple[np.ndarray, np.ndarray]]:
    words, owner = word_hashes(data, off, a, b)
    pairs, at = features(words, owner)
    return [(words, owner), (pairs, owner[at])]


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, key, documents, tokens) of a slice of texts."""
    for batch in batches:
        data, off = text_bytes(batch.column(0))
        for a, b in slices(off):
            for pair, (h, owner) in enumerate(_kinds(data, off, a, b)):
                keys, times = np.unique(distinct(h, owner)[0], return_counts=True)
                tokens = np.zeros(len(keys), np.int64)
                tokens[:1] = 0 if pair else len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), bool(pair))), pa.array(as_long(keys)), pa.array(times.astype(np.int64)), pa.array(tokens)], names=["pair", "key", "c", "tokens"])


def frequent(d: DataFrame, n: int, scratch: Scratch) -> tuple[list[np.ndarray], int]:
    """(sorted words and bigrams that are frequent, about how many tokens d(k, text) has)."""
    every = max(1, n // LOOKED_AT)
    seen = scratch.table(d.where(F.expr(f"pmod(k ^ shiftright(k, 16), {every}) = 0")).select("text").mapInArrow(_look, "pair boolean, key long, c long, tokens long").groupBy("pair", "key").agg(F.sum("c").alias("c"), F.sum("tokens").alias("tokens")))
    tokens = seen.agg(F.sum("tokens")).first()[0] or 0
    out = []
    for pair in (False, True):
        top = seen.where((F.col("pair") == pair) & (F.col("c") >= FREQUENT)).orderBy(F.desc("c"), "key").limit(HOT).select("key").toArrow()
        out.append(np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64)))
    scratch.drop(seen)
    return out, tokens * every


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["bucket", "hot", "keys", "g", "n"])


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as many bytes as they need."""
    top = int(np.abs(x).max(initial=0))
    return x.astype("<i1" if top < 1 << 7 else "<i2" if top < 1 << 15 else "<i8")


def _wide(column, keys) -> np.ndarray:
    """What _narrow made of one number a key, over all rows."""
    parts = [np.frombuffer(x, f"<i{8 * len(x) // len(k)}") for x, k in zip(column.to_pylist(), keys.to_pylist(), strict=True)]
    return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)


def _count(shared, buckets: int, groups: int):
    """mapInArrow: (k, text, target) to counts by range of keys, words in even buckets and
    bigrams in odd ones: frequent keys once a task, others once a document with its group,
    negative in targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        sums = [np.zeros((2, len(h)), np.int64) for h in hot]
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(2).to_pylist(), bool)
            data, off = text_bytes(batch.column(1))
            for a, b in slices(off, 4 * SLICE_BYTES):
                rows = []
                for pair, (h, owner) in enumerate(_kinds(data, off, a, b)):
                    keys, o, n, _ = distinct(h, owner)
                    at, known = find(hot[pair], keys)
                    t = marks[o]
                    np.add.at(sums[pair][0], at[known & t], n[known & t])
                    np.add.at(sums[pair][1], at[known], n[known])
                    keys, o, n = keys[~known], o[~known], np.where(t, -n, n)[~known]
                    g = group_of(ids[o], groups)
                    edges = bucket_edges(keys, buckets)
                    rows += [(2 * i + pair, False, keys[x:y].tobytes(), _narrow(g[x:y]).tobytes(), _narrow(n[x:y]).tobytes()) for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if x < y]
                yield _counted(rows)
        for pair in (0, 1):
            some = np.flatnonzero(sums[pair][1])
            keys, (t, n) = hot[pair][some], sums[pair][:, some]
            edges = bucket_edges(keys, buckets)
            for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if x < y:
                    yield _counted([(2 * i + pair, True, keys[x:y].tobytes(), t[x:y].tobytes(), n[x:y].tobytes())])

    return run


def _joined(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _sums(keys: np.ndarray, t: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys, sums of t and b, entries of each, the order of the entries)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    if not len(keys):
        return keys, t, b, first, order
    return keys[first], np.add.reduceat(t[order], first), np.add.reduceat(b[order], first), np.diff(np.append(first, len(keys))), order


def _sum(table: pa.Table) -> pa.Table:
    """A bucket's counts to sums: of frequent keys (g = -1), and of the other keys that
    two documents have, for each group of documents that has them."""
    pair = bool(table.column("bucket")[0].as_py() % 2)
    hot, cold = table.filter(table.column("hot")), table.filter(pc.invert(table.column("hot")))
    keys, t, b, _, _ = _sums(_joined(hot["keys"], "<u8"), _joined(hot["g"], "<i8"), _joined(hot["n"], "<i8"))
    totals = [len(keys), int(t.sum()), int(b.sum())]
    rows = []
    n = _wide(cold["n"], cold["keys"])
    known = _sums(_joined(cold["keys"], "<u8"), np.maximum(-n, 0), np.abs(n))
    del n
    totals = [x + y for x, y in zip(totals, (len(known[0]), int(known[1].sum()), int(known[2].sum())), strict=True)]
    rows.append((-1, pair, keys.tobytes(), t.tobytes(), b.tobytes(), *([0] * 3 if pair else totals)))
    which = np.repeat(np.arange(len(known[0])), known[3])
    g = _wide(cold["g"], cold["keys"])[known[4]]
    shared = known[3][which] > 1
    both = np.unique(g[shared] * len(known[0]) + which[shared])
    g, which = both // max(1, len(known[0])), both % max(1, len(known[0]))
    edges = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g)) if len(g) else [0]
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        w = which[x:y]
        rows.append((int(g[x]), pair, known[0][w].tobytes(), _narrow(known[1][w]).tobytes(), _narrow(known[2][w]).tobytes(), 0, 0, 0))
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 3, *[pa.int64()] * 3]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in SUMMED.split(", ")])


class Models:
    """What all documents need: sorted frequent words and bigrams with their counts in the
    target and in all text, the tokens of both, and the vocabulary's size."""

    def __init__(self, hot: list[tuple[np.ndarray, np.ndarray, np.ndarray]], totals: tuple[int, int], size: int):
        self.hot, self.totals, self.size = hot, totals, max(1, size)

    def counts(self, pair: int, keys: np.ndarray, others: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(target's counts, all counts, which keys more than their own document has)."""
        t, b, there = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for table, in_t, in_b in (others, self.hot[pair]):
            at, known = find(table, keys)
            t[known], b[known] = in_t[at[known]], in_b[at[known]]
            there |= known
        return t, b, there

    def losses(self, words: np.ndarray, owner: np.ndarray, targets: np.ndarray, others: list) -> list[np.ndarray]:
        """Per word, -ln p under the target and the background model, each without what the
        word's own document (targets: whether it is a target) added to it. others: the
        counts of keys that aren't frequent, of words and of bigrams."""
        pairs, at = features(words, owner)
        l2, l1, l0 = LAMBDAS
        left = []
        for pair, (h, o) in enumerate(((words, owner), (pairs, owner[at]))):
            keys, doc, n, place = distinct(h, o)
            t, b, there = self.counts(pair, keys, others[pair])
            left.append([np.where(there, c - n * counted, 0)[place] for c, counted in ((t, targets[doc]), (b, True))])
        tokens = np.bincount(owner, minlength=len(targets))[owner]
        out = []
        for i, counted in enumerate((targets[owner], np.ones(len(words), bool))):
            one = left[0][i] / np.maximum(self.totals[i] - tokens * counted, 1.0)
            two = left[1][i] / np.maximum(left[0][i][at], 1)
            more = l2 * one
            more[at + 1] = l2 * np.clip(two, 0.0, 1.0)
            out.append(-np.log(l1 * one + l0 / self.size + more))
        return out


def fit(docs: DataFrame, scratch: Scratch) -> tuple[Models, DataFrame, int]:
    """docs(k, text, target): (models, counts of the other keys by group of documents, the
    number of groups)."""
    n = docs.count()
    hot, tokens = frequent(docs, n, scratch)
    buckets, groups = max(1, -(-tokens // RANGE_TOKENS)), n // GROUP_DOCS | 1
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    counted = docs.select("k", "text", "target").mapInArrow(_count(shared, buckets, groups), COUNTED)
    summed = scratch.table(counted.groupBy("bucket").applyInArrow(_sum, SUMMED))
    tables, size, totals = [[], []], 0, [0, 0]
    for r in summed.where("g = -1").collect():
        tables[r.pair].append((np.frombuffer(r["keys"], "<u8"), np.frombuffer(r.t, "<i8"), np.frombuffer(r.b, "<i8")))
        size, totals = size + r.words, [totals[0] + r.tokens_t, totals[1] + r.tokens_b]
    free(docs.sparkSession)  # the shuffled counts, before texts are shuffled
    return Models([_sorted(t) for t in tables], (totals[0], totals[1]), size), summed.where("g >= 0"), groups


def _sorted(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables in one, by key, each key once."""
    parts = parts or [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    keys, t, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, at = np.unique(keys, return_index=True)
    return keys, t[at], b[at]


def score(docs: DataFrame, models: Models, others: DataFrame, groups: int) -> DataFrame:
    """doc_id, n_tokens, ce_target, ce_background, score for every row of docs(k, doc_id,
    text, target); a document is scored by the models without its own counts, so that being
    a target is no merit in itself."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(some: pa.Table, counts: pa.Table) -> pa.Table:
        known = []
        for pair in (False, True):
            part = counts.filter(pc.equal(counts.column("pair"), pair))
            known.append(_sorted([(_joined(part["keys"], "<u8"), _wide(part["t"], part["keys"]), _wide(part["b"], part["keys"]))]))
        data, off = text_bytes(some.column("text"))
        n = some.num_rows
        marks = np.array(some.column("target").to_pylist(), bool)
        count, sums = np.zeros(n, np.int64), [np.zeros(n), np.zeros(n)]
        for a, b in slices(off):
            words, owner = word_hashes(data, off, a, b)
            count[a:b] = np.bincount(owner - a, minlength=b - a)
            for s, loss in zip(sums, shared.value.losses(words, owner - a, marks[a:b], known), strict=True):
                s[a:b] = np.bincount(owner - a, loss, minlength=b - a)
        t, g = (s / np.maximum(count, 1) for s in sums)
        return pa.table([some.column("doc_id"), pa.array(count), pa.array(t), pa.array(g), pa.array(g - t)], names=["doc_id", "n_tokens", "ce_target", "ce_background", "score"])

    dealt = docs.select(F.expr(f"cast(pmod(k ^ shiftright(k, 16), {groups}) as int)").alias("g"), F.col("doc_id").cast("long"), "text", "target")
    return dealt.groupBy("g").cogroup(others.select("g", "pair", "keys", "t", "b").groupBy("g")).applyInArrow(run, "doc_id long, n_tokens long, ce_target double, ce_background double, score double")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document; the target is the text of documents labelled quality 1 and not
    toxic, the background all text.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Null and wordless texts have no tokens
    and losses of 0. Without target documents the target model is uniform. A doc_id that
    repeats is labelled in every row, and is a target if any of its labels says so; repeated
    rows are counted and scored each; an empty table gives no rows; extra columns are
    ignored."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct().withColumn("target", F.lit(True))
    good = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good.hint("shuffle_hash")
    scratch = Scratch(docs.sparkSession)
    marked = keyed(docs, scratch).join(good, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    return score(marked, *fit(marked, scratch))
