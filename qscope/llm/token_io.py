"""Token-id files with bit-plane shuffling.

A file is a header, chunks and a chunk index. A chunk holds a block of ids of one fixed
size (the last may be shorter), transposed into byte or bit planes, each compressed with
zstandard by itself: high planes are nearly constant and shrink to almost nothing.

    header   magic 'QPL1', plane kind u8 (0 bytes, 1 bits), id bytes u8, 2 zero bytes,
             ids a chunk u32
    chunk    for each plane its length u32, then the planes
    index    for each chunk: offset u64, length u64, ids u32, crc32 of its ids u32
    footer   chunks u32, documents u32, ids u64, index offset u64, magic 'QPLX'

Documents' lengths are a chunked stream of the same format in a second file image, so a
reader finds any document without decoding others' ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qscope.llm.common import Scratch, keyed, lean, number_rows, partitions, range_part, small
from qscope.llm.tokens import encoder

MAGIC, TAIL = b"QPL1", b"QPLX"
CHUNK_IDS = 1 << 16
LEVEL = 3
#: Ids after which a worker closes a file and begins the next.
FILE_IDS = 1 << 22


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of a block, most significant first."""
    by = ids.astype(">u4").view(np.uint8).reshape(-1, 4).T
    if not bits:
        return [np.ascontiguousarray(p).tobytes() for p in by]
    return [np.packbits(by[p] >> (7 - j) & 1).tobytes() for p in range(4) for j in range(8)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], 1).reshape(-1).view(">u4").astype(np.uint32)
    out = np.zeros(n, np.uint32)
    for p in planes:
        out = out << np.uint32(1) | np.unpackbits(np.frombuffer(p, np.uint8), count=n)
    return out


def write_ids(ids: np.ndarray, documents: int, bits: bool = False, chunk_ids: int = CHUNK_IDS) -> bytes:
    """The file's bytes for unsigned 32-bit ids."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    out = [MAGIC + struct.pack("<BBHI", bits, 4, 0, chunk_ids)]
    at, index = len(out[0]), []
    for a in range(0, len(ids), chunk_ids):
        block = ids[a : a + chunk_ids]
        planes = [press.compress(p) for p in to_planes(block, bits)]
        chunk = struct.pack(f"<{len(planes)}I", *map(len, planes)) + b"".join(planes)
        index.append(struct.pack("<QQII", at, len(chunk), len(block), crc32(block.astype("<u4").tobytes())))
        out.append(chunk)
        at += len(chunk)
    return b"".join([*out, *index, struct.pack("<IIQQ", len(index), documents, len(ids), at), TAIL])


def read_ids(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first..last-1 (all by default); only the chunks that hold them are decoded. Raises
    ValueError where magic numbers, lengths or checksums don't hold."""
    if data[:4] != MAGIC or data[-4:] != TAIL:
        raise ValueError("not a token-id file")
    bits, _, _, chunk_ids = struct.unpack("<BBHI", data[4:12])
    chunks, _, total, at = struct.unpack("<IIQQ", data[-28:-4])
    last = total if last is None else last
    if not 0 <= first <= last <= total:
        raise ValueError(f"ids {first}..{last} of {total}")
    un, out, n = zstandard.ZstdDecompressor(), [], 32 if bits else 4
    for c in range(first // chunk_ids, -(-last // chunk_ids) if last > first else 0):
        offset, _, count, crc = struct.unpack_from("<QQII", data, at + 24 * c)
        lengths = struct.unpack_from(f"<{n}I", data, offset)
        offset += 4 * n
        planes = []
        for size in lengths:
            planes.append(un.decompress(data[offset : offset + size]))
            offset += size
        block = from_planes(planes, count, bool(bits))
        if crc32(block.astype("<u4").tobytes()) != crc:
            raise ValueError(f"chunk {c} is damaged")
        out.append(block[max(0, first - c * chunk_ids) : last - c * chunk_ids])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


FILES = "bucket int, file int, first_rn long, documents int, ids binary, lengths binary"
DIGESTS = "rn long, local long, n_tokens long, ids_crc32 long, bucket int, file int"


def _encode(path: str, end: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, True, end)
        state: dict = {}

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(state["parts"]), "<u4")
            lengths = np.array([len(p) // 4 for p in state["parts"]], np.uint32)
            row = [[state["bucket"]], [state["file"]], [state["first"]], [len(lengths)], [write_ids(ids, len(lengths), bits)], [write_ids(lengths, len(lengths), bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            state.update(parts=[], size=0, file=state["file"] + 1)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["bucket", "file", "first_rn", "documents", "ids", "lengths"])

        for batch in batches:
            texts = enc.encode_all(text.as_py() or "" for text in batch.column(2))
            for bucket, rn, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                if state.get("parts") and (bucket != state["bucket"] or state["size"] >= 4 * FILE_IDS):
                    yield close()
                if state.get("bucket") != bucket:
                    state.update(bucket=bucket, file=0, parts=[], size=0)
                if not state["parts"]:
                    state["first"] = rn
                state["parts"].append(ids)
                state["size"] += len(ids)
        if state.get("parts"):
            yield close()
        enc.settle()

    return lean(run)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, file, first, ids, lengths in zip(*(batch.column(i) for i in range(5)), strict=True):
            ids, lengths = read_ids(ids.as_py()), read_ids(lengths.as_py()).astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(lengths)])
            raw = ids.astype("<u4").tobytes()
            crc = [crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            n = len(lengths)
            cols = [np.arange(n) + first.as_py(), edges[:-1], lengths, np.array(crc, np.int64)]
            arrays = [pa.array(c, pa.int64()) for c in cols] + [pa.array(np.full(n, v.as_py()), pa.int32()) for v in (bucket, file)]
            yield pa.RecordBatch.from_arrays(arrays, names=["rn", "local", "n_tokens", "ids_crc32", "bucket", "file"])


def write_corpus(docs: DataFrame, path: str, end: int, scratch: Scratch, bits: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, names). files: bucket, file, first_rn, documents, ids, lengths: the two file
    images of each file, in the shared folder, documents in ascending doc_id order over
    (bucket, file). names: rn, doc_id."""
    spark = docs.sparkSession
    d = keyed(docs, scratch)
    ranks = number_rows(d.select("k", "doc_id"), ["k"], scratch, "rn")
    names = scratch.table(ranks.select("k", "rn", "doc_id"))
    n, total = partitions(spark), max(1, ranks._total)
    # Ranges of row numbers as buckets: their bounds are exact, so no sampling decides them.
    bounds = names.withColumn("bucket", F.expr(f"cast(rn * {n} div {total} as int)")).groupBy("bucket").agg(F.min("k").alias("lo"), F.min("rn").alias("rn0")).orderBy("bucket").collect()
    lows = [r.lo for r in bounds]
    starts = {i: r.rn0 for i, r in enumerate(bounds)}
    if not lows:
        lows, starts = [0], {0: 0}
    withb = d.select(range_part("k", lows).alias("bucket"), "k", "text")
    files = withb.repartitionById(n, "bucket").sortWithinPartitions("bucket", "k").mapInArrow(_encode(path, end, bits), FILES)
    files = scratch.table(files, "none")
    starts_df = spark.createDataFrame(list(starts.items()), "bucket int, rn0 long")
    before = Window.partitionBy("bucket").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = files.select("bucket", "file", "documents").withColumn("_before", F.coalesce(F.sum("documents").over(before), F.lit(0)))
    firsts = firsts.join(F.broadcast(starts_df), "bucket").select("bucket", "file", (F.col("rn0") + F.col("_before")).alias("first_rn"))
    files = files.drop("first_rn").join(small(firsts), ["bucket", "file"])
    return files.select("bucket", "file", "first_rn", "documents", "ids", "lengths"), names


def read_corpus(files: DataFrame, names: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the file images alone; names give the ids of
    the documents. Totals, one a bucket, are
    summed on the driver."""
    spark = files.sparkSession
    digests = scratch.table(files.select("bucket", "file", "first_rn", "ids", "lengths").mapInArrow(_decode, DIGESTS))
    totals = scratch.table(digests.groupBy("bucket", "file").agg(F.sum("n_tokens").alias("n")))
    rows, at = [], 0
    for r in totals.groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket").collect():
        rows.append((r.bucket, at))
        at += r.n
    starts = spark.createDataFrame(rows or [(0, 0)], "bucket int, _at long")
    before = Window.partitionBy("bucket").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_b", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(starts), "bucket").select("bucket", "file", (F.col("_at") + F.col("_b")).alias("_s"))
    out = digests.join(small(starts), ["bucket", "file"]).join(names, "rn")
    return out.select("doc_id", (F.col("_s") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, end: int = 2, bits: bool = False) -> DataFrame:
    """Encode every whole text with the tokenizers file, append the end id, write the ids in
    ascending doc_id order, read the files back, and return doc_id, start, n_tokens and
    ids_crc32 as read. Null and empty texts are the end id alone; rows that repeat a doc_id
    are documents of their own, ordered by text; an empty table gives no rows; extra columns
    are ignored."""
    scratch = Scratch(docs.sparkSession)
    files, names = write_corpus(docs, path, end, scratch, bits)
    return read_corpus(files, names, scratch)
