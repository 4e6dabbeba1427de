"""Shared pieces of the training-data operators: scratch tables in the cluster's shared
folder, row keys and global row numbers, and vectorised word and shingle hashing over
Arrow string buffers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are turned into 64-bit arrays at once; bounds a worker's memory.
SLICE_BYTES = 1 << 20
#: Rows that go to a Python worker at once, unless the session sets a number of its own:
#: texts are long, and batches are held on both sides.
ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
#: Largest table, in rows of at most 16 bytes, that is broadcast after its size was counted.
BROADCAST_ROWS = 1 << 20


# ---------------------------------------------------------------- scratch tables


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it. On
    a cluster the package is installed or given with --py-files. Batches to workers are cut
    to BATCH_ROWS where the session has Spark's default."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)
    root = str(Path(__file__).resolve().parents[2])
    found = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in found.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, found]))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (single machine, as in
    tests) a temporary one that is then recorded in the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("qscope.scratch.dir", None) or "file://" + tempfile.mkdtemp(prefix="qscope-")
        spark.conf.set("qscope.scratch.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder. They cut lineage: a lost executor loses no
    result, and the shuffle files behind a written table can be freed at once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/qscope-{uuid.uuid4().hex}"
        self._n = 0
        ship(spark)

    def table(self, df: DataFrame, codec: str = "zstd", rows: int | None = None) -> DataFrame:
        """df, written. rows: how many go to a Python worker at once in this step."""
        self._n += 1
        path, before = f"{self.root}/{self._n}", self.spark.conf.get(ARROW_ROWS)
        try:
            if rows:
                self.spark.conf.set(ARROW_ROWS, rows)
            df.write.option("compression", codec).parquet(path)
        finally:
            self.spark.conf.set(ARROW_ROWS, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        free(self.spark)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)
        free(self.spark)


def lean(run: Callable) -> Callable:
    """A worker's function over batches that gives its memory back to the system when it
    ends, as idle workers stay."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now."""
    gc.collect()
    spark._jvm.System.gc()


def rest(spark: SparkSession) -> None:
    """Let idle executors collect their garbage and give the heap back that they don't need:
    they would keep it at its largest from one stage to the next. Nothing rests on it."""
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def number_rows(df: DataFrame, order: list[str], scratch: Scratch, name: str = "_rn") -> DataFrame:
    """df plus a gapless 0-based row number in the given order, without a global window:
    a range partitioning, a local index, and the partitions' counts (as many as there are
    partitions) summed on the driver. The rows are written once, so that the numbers hold
    when a later stage is run again."""
    spark = df.sparkSession
    n = partitions(spark)
    cols = [F.col(c).asc_nulls_first() for c in order]
    part = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    part = scratch.table(part.withColumn("_i", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_i"), 33)
    counts = sorted((r[0], r[1]) for r in part.groupBy(pid.alias("_p")).count().collect())
    rows, total = [], 0
    for p, c in counts:
        rows.append((int(p), int(total)))
        total += c
    starts = spark.createDataFrame(rows or [(0, 0)], "_p long, _s long")
    out = part.withColumn("_p", pid.cast("long")).join(F.broadcast(starts), "_p")
    out = out.withColumn(name, F.col("_s") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)))
    out = out.drop("_p", "_s", "_i")
    out._scratch_path = part._scratch_path
    out._total = total
    return out


def keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(k long, doc_id, text): k is doc_id. Where doc_ids repeat or are null, k is the row's
    number by (doc_id, text) instead, nulls first, so that every row is a document of its own."""
    d = docs.select("doc_id", "text")
    bad = d.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    if bad:
        out = number_rows(d, ["doc_id", "text"], scratch, "k").select("k", "doc_id", "text")
    else:
        out = d.select(F.col("doc_id").cast("long").alias("k"), "doc_id", "text")
    out._renumbered = bool(bad)
    return out


def only(df: DataFrame, ids: DataFrame, key: str | list[str], how: str) -> DataFrame:
    """Semi or anti join against a narrow id table: broadcast if the counted size allows,
    otherwise a shuffled hash join (no sort of the wide side)."""
    if ids.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(ids), key, how)
    return df.join(ids.hint("shuffle_hash"), key, how)


def copies_of(d: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((k, rep): the least k with the same text; (rep, c): texts of several documents and how
    many they are)."""
    texts = scratch.table(d.select("k", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h")))
    classes = scratch.table(texts.groupBy("h").agg(F.min("k").alias("rep"), F.count("*").alias("c")).where("c > 1"))
    n, total = classes.count(), texts.count()
    if n <= BROADCAST_ROWS:
        of = texts.join(F.broadcast(classes.drop("c")), "h", "left")
    else:
        # Classes of over a 4096th of all rows, 4096 at most, are broadcast; the rest is dealt
        # by text, in shares of bounded size.
        large = classes.where(F.col("c") * 4096 > total).select("h", F.col("rep").alias("_large"))
        of = texts.join(F.broadcast(large), "h", "left").withColumn("h", F.when(F.col("_large").isNull(), F.col("h")).otherwise(F.col("k").cast("string")))
        of = of.join(classes.drop("c").hint("shuffle_hash"), "h", "left").withColumn("rep", F.coalesce("_large", "rep"))
    return scratch.table(of.select("k", F.coalesce("rep", "k").alias("rep"))), classes.select("rep", "c")


# ---------------------------------------------------------------- arrow text


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    if offs is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes each, one document at least."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit words that depend on the seed alone."""
    base = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(mix(base))


class Poly:
    """Hashes of byte ranges from prefix sums: sum of T[byte] * B^i modulo 2^64, brought to
    position 0 by B^-start."""

    def __init__(self, seed: int):
        words = stream(seed, 257)
        self.table, self.base = words[:256] | np.uint64(1), words[256] | np.uint64(5)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self._pow = self._inv = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._pow) < n:
            n = 1 << (n - 1).bit_length()
            a, b = np.full(n, self.base, np.uint64), np.full(n, self.inverse, np.uint64)
            a[0] = b[0] = 1
            self._pow, self._inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
        return self._pow, self._inv

    def prefix(self, b: np.ndarray) -> np.ndarray:
        up, _ = self.powers(len(b) + 1)
        out = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.table[b] * up[: len(b)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.powers(len(prefix))[1][start]


WORD_POLY = Poly(11)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
SHINGLE_MULTIPLIERS = stream(12, 64) | np.uint64(1)
SHORT_SALTS = stream(13, 64)


def _cuts(data: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """[a, b) in pieces of about SLICE_BYTES that end at white space, or longer ones where
    a single word is longer."""
    while a < b:
        e = min(b, a + SLICE_BYTES)
        while e < b and not SPACE[data[e]]:
            near = np.flatnonzero(SPACE[data[e : e + 65536]][: b - e])
            e = e + int(near[0]) if len(near) else min(b, e + 65536)
        yield a, e
        a = e


def word_hashes(data: np.ndarray, off: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ (A-Z lower-cased) of documents a..b-1 and each
    word's document."""
    hashes, owners = [], []
    for s, e in _cuts(data, int(off[a]), int(off[b])):
        x = LOWER[data[s:e]]
        n = e - s
        word = ~SPACE[x]
        first = np.zeros(n + 1, bool)
        edges = off[a : b + 1]
        edges = edges[(edges > s) & (edges < e)] - s
        first[edges] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | first[1:n]
        end = word.copy()
        end[:-1] &= ~word[1:] | first[1:n]
        start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        hashes.append(mix(WORD_POLY.ranges(WORD_POLY.prefix(x), start, stop) + (stop - start).astype(np.uint64)))
        owners.append(np.searchsorted(off[a : b + 1], start + s, "right") - 1 + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def shingles(words: np.ndarray, owner: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles and their documents, in document order; a document of
    fewer words has its whole sequence as one."""
    m = len(words) - n + 1
    if m > 0:
        acc = words[:m] * SHINGLE_MULTIPLIERS[0]
        for j in range(1, n):
            acc += words[j : j + m] * SHINGLE_MULTIPLIERS[j]
        whole = owner[:m] == owner[n - 1 :]
        out, doc = mix(acc[whole]), owner[:m][whole]
    else:
        out, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ids, starts, counts = np.unique(owner, return_index=True, return_counts=True)
    few = np.flatnonzero(counts < n)
    if len(few):
        extra = np.array([(words[s : s + c] * SHINGLE_MULTIPLIERS[:c]).sum(dtype=np.uint64) for s, c in zip(starts[few], counts[few], strict=True)]) + SHORT_SALTS[counts[few]]
        out, doc = np.concatenate([out, mix(extra)]), np.concatenate([doc, ids[few]])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc


def shingle_slices(col: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sizes, features) of the sets of some rows at a time: the sorted distinct
    shingle hashes of one row follow those of the row before."""
    data, off = text_bytes(col)
    for a, b in slices(off):
        h, doc = shingles(*word_hashes(data, off, a, b), n)
        bounds = np.searchsorted(doc, np.arange(a, b + 1)).tolist()
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            h[s:e].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        yield a, np.bincount(doc[new] - a, minlength=b - a), h[new]


def shingle_sets(col: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of a string column."""
    for a, counts, h in shingle_slices(col, n):
        ends = np.cumsum(counts).tolist()
        for i, (s, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            yield a + i, h[s:e]


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def packed(k: np.ndarray) -> bytes:
    """The first number, and the steps to the next ones in as few bytes as they need."""
    step = np.diff(k, prepend=k[:1])
    top = int(np.abs(step).max(initial=0))
    return k[:1].tobytes() + step.astype("<i1" if top < 1 << 7 else "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """What packed made of n numbers."""
    if not n:
        return np.zeros(0, np.int64)
    step = np.frombuffer(raw[8:], f"<i{(len(raw) - 8) // n}").astype(np.int64)
    return np.cumsum(step) + np.frombuffer(raw[:8], "<i8")[0]


def range_part(column: str, lows: list[int]) -> F.Column:
    """The index of the last of the ascending `lows` that is not above the column, 0 if none
    is: a binary search in one constant array, so the expression stays small however many
    there are."""
    if not lows:
        return F.lit(0)
    steps = ", ".join(str(1 << i) for i in range(max(1, len(lows).bit_length()) - 1, -1, -1))
    table = f"cast(split('{','.join(map(str, lows))}', ',') as array<bigint>)"
    return F.expr(f"aggregate(array({steps}), 0, (at, step) -> if(at + step < {len(lows)} AND get({table}, at + step) <= {column}, at + step, at))")


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its counted rows allow."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
