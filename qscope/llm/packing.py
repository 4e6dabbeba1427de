"""Best-fit packing of documents into sequences: vector best-fit over residual tokens,
document count and attention cost."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qscope.llm.common import Scratch, keyed, lean
from qscope.llm.tokens import encoder

#: Weights of the residual tokens, documents and attention cost.
WEIGHTS = (1.0, 0.5, 0.5)
PIECES = "k long, doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: np.ndarray, capacity: int, max_docs: int, max_cost: int, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> list[tuple[int, list[int]]]:
    """[(bins, lengths of a bin's pieces)] for counts[l] pieces of length l.

    Items with one length are alike, and so are bins with the same contents, so both are
    handled as classes: lengths from the longest down; a length's pieces go to the class of
    open bins that fits them under all three constraints and is best by the rule, until all
    are placed; the rest opens new bins. rule "norm": the least weighted norm of what the bin
    has left after it, so a bin takes as many alike as fit before the next one does; "dot":
    the greatest weighted dot product of the piece and what the bin has left, so bins of a
    class take one each. Of classes that tie, the one that was opened first is taken. That is
    what best-fit piece by piece would do. The work depends on the capacity, not on the
    number of documents."""
    scale = np.array([capacity, max_docs, max_cost], float)
    contents: list[list[int]] = []
    left = np.zeros((0, 3))
    number = np.zeros(0, np.int64)
    w = np.array(weights)
    for length in range(len(counts) - 1, 0, -1):
        todo = int(counts[length])
        item = np.array([length, 1.0, float(length) ** 2])
        while todo:
            fits = (left >= item).all(1) & (number > 0) if len(left) else np.zeros(0, bool)
            if fits.any():
                after = (left[fits] - item) / scale
                score = -(after * after @ w) if rule == "norm" else (left[fits] / scale) @ (w * item / scale)
                best = int(np.flatnonzero(fits)[np.argmax(score)])
                room, held, there = left[best], contents[best], int(number[best])
            else:
                room, held, there = scale, [], todo
                if (room < item).any():
                    raise ValueError(f"a piece of {length} tokens breaks a constraint on its own")
                best = -1
            each = min(todo, int((room // item).min())) if rule == "norm" or best < 0 else 1
            n = min(there, todo // each)
            if best >= 0:
                number[best] -= n
            contents.append([*held, *[length] * each])
            left, number = np.vstack([left, room - item * each]), np.append(number, n)
            todo -= n * each
    return [(int(n), c) for n, c in zip(number, contents, strict=True) if n]


def cut(path: str, end: int, capacity: int):
    """mapInArrow: texts to pieces of at most capacity tokens; only the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, False, end)
        for batch in batches:
            k, d, piece, start, length, crc = [], [], [], [], [], []
            texts = enc.encode_all(text.as_py() or "" for text in batch.column(2))
            for key, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i in range(len(edges) - 1):
                    a, b = edges[i], edges[i + 1]
                    k.append(key), d.append(doc), piece.append(i), start.append(a), length.append(b - a), crc.append(crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(d, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["k", "doc_id", "piece", "start", "length", "ids_crc32"])
        enc.settle()

    return lean(run)


def pack(docs: DataFrame, path: str, end: int = 2, capacity: int = 1024, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id (null and empty text: the end id alone); longer
    ones are cut into pieces of `capacity`, the first of which may be shorter. The driver
    packs a histogram of the pieces' lengths, at most `capacity` numbers, and the pieces of
    a length are dealt to the plan's bins by their number within that length. max_docs and
    max_cost (the sum of squared lengths) default to what the capacity implies, as lower ones
    can add sequences; what is left of them still weighs in the choice of a bin. Pieces of a
    length are numbered within partitions and by the partitions' counts, so no window or
    task holds all of them. Repeated rows are documents of their own; an empty table gives
    no rows; extra columns are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    pieces = keyed(docs, scratch).select("k", F.col("doc_id").cast("long"), "text").mapInArrow(cut(path, end, capacity), PIECES)
    # The local index numbers the rows of each written partition, sorted by length.
    pieces = scratch.table(pieces.sortWithinPartitions("length").withColumn("_i", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_i"), 33)
    per = scratch.table(pieces.groupBy("length", part.alias("_part")).agg(F.count("*").alias("n"), F.min("_i").alias("_first")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    bins = plan(counts, capacity, max_docs or capacity, max_cost or capacity**2, rule, weights)
    # A run: pieces first..first+n*each-1 of a length go, `each` a bin, to n bins from `bin`.
    runs, used, at = [], np.zeros(capacity + 1, np.int64), 0
    for n, inside in bins:
        offset = 0
        for length in sorted(set(inside), reverse=True):
            each = inside.count(length)
            runs.append((length, int(used[length]), n * each, at, each, offset))
            used[length] += n * each
            offset += each * length
        at += n
    runs_df = spark.createDataFrame(runs or [(0, 0, 0, 0, 1, 0)], "length long, first long, n long, bin long, each long, at long")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "_part", "_first", "_before")
    byl = runs_df.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "n", "bin", "each", "at"))).alias("_runs"))
    ranked = pieces.withColumn("_part", part).join(per, ["length", "_part"]).withColumn("_rank", F.col("_i") - F.col("_first") + F.col("_before"))
    found = F.expr("element_at(filter(_runs, x -> x.first <= _rank AND _rank < x.first + x.n), 1)")
    out = ranked.join(F.broadcast(byl), "length").withColumn("_run", found)
    index = F.expr("_rank - _run.first")
    return out.withColumn("_x", index).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("_run.bin + _x div _run.each").alias("sequence_id"),
        F.expr("_run.at + (_x % _run.each) * length").alias("offset"),
    )
