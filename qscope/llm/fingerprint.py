"""Document fingerprints: one-permutation MinHash with optimal densification, packed to the
low bits of each bin."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qscope.llm.common import Scratch, keyed, mix, number_rows, partitions, range_part, shingle_sets

BINS, BITS = 256, 8


def one_permutation(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Each bin's least hash, or, where it got none, that of another bin chosen by a hash of
    (bin, attempt) alone: the same choice for every document. No shingles: all bins 0."""
    if not len(shingles):
        return np.zeros(bins, np.uint64)
    h = mix(shingles)
    which = (h >> np.uint64(32)).astype(np.int64) % bins
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, which, h)
    full = np.zeros(bins, bool)
    full[which] = True
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        attempt += 1
        donor = (mix(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        ok = full[donor]
        out[empty[ok]] = out[donor[ok]]
        empty = empty[~ok]
    return out


def pack(signature: np.ndarray, empty: bool, bits: int = BITS) -> bytes:
    """The low bits of every bin, `bits` each, after a byte that says whether there were
    shingles."""
    low = (mix(signature) & np.uint64((1 << bits) - 1)).astype(np.uint8) if bits <= 8 else None
    if low is None:
        raise ValueError("at most 8 bits")
    planes = np.unpackbits(low[:, None], axis=1)[:, 8 - bits :]
    return bytes([not empty]) + np.packbits(planes.reshape(-1)).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimated Jaccard similarity: the share m of equal bins, corrected for bins that agree
    by chance, (m - 2^-bits) / (1 - 2^-bits), not below 0. Two empty sets: 1, one: 0."""
    if a == b:
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8, offset=1)).reshape(-1, bits) for v in (a, b))
    m, c = float((x == y).all(1).mean()), 2.0**-bits
    return max(0.0, (m - c) / (1 - c))


def fingerprints(texts: list[str], bins: int = BINS, bits: int = BITS) -> list[bytes]:
    return [pack(one_permutation(s, bins), not len(s), bits) for _, s in shingle_sets(pa.array(texts, pa.large_string()))]


def edited(text: str, following: str) -> str:
    """The last third of the text's code points replaced by the first as many of another."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ROWS = 64


def _compare(bins: int, bits: int):
    """mapInArrow over (part, k, doc_id, guest, text), sorted by part and k descending: each
    row and the one after it. A guest is the first row of the next part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = []

        def pairs(rows: list) -> pa.RecordBatch:
            # rows: (part, doc, guest, text, print); each but the last with its follower.
            held = [(r, s) for r, s in zip(rows, rows[1:], strict=False) if not r[2] and r[0] == s[0]]
            texts = [edited(r[3], s[3]) for r, s in held]
            prints = fingerprints(texts, bins, bits)
            cols = [[r[1] for r, _ in held], [len(r[3]) for r, _ in held], [hashlib.sha256(t.encode()).hexdigest() for t in texts], [r[4].hex() for r, _ in held], [p.hex() for p in prints]]
            cols += [[likeness(r[4], p, bits) for (r, _), p in zip(held, prints, strict=True)], [likeness(r[4], s[4], bits) for r, s in held]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])

        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                texts = [t or "" for t in part.column(3).to_pylist()]
                new = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), texts, fingerprints(texts, bins, bits), strict=True))
                yield pairs([*last, *new])
                last = new[-1:]

    return run


def fingerprint(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint covers the five-word shingles of the whole text (null: empty). The next
    document is the next by descending doc_id, after the last the first; rows that repeat a
    doc_id, or have none, are documents of their own, ordered by text. A single document is
    its own next. An empty table gives no rows; extra columns are ignored. Rows meet their
    successors by a range partitioning; a copy of each part's first row closes the part
    before it, so no window runs over all rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = keyed(docs, scratch)
    ranks = number_rows(d.select("k"), ["k"], scratch)
    n, total = partitions(spark), max(1, ranks._total)
    heads = ranks.withColumn("_b", F.expr(f"cast(_rn * {n} div {total} as int)")).groupBy("_b").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("_b").collect()
    m = len(heads)
    # Part i ends with its highest row, which, as a guest, also closes part i + 1.
    part = range_part("k", [r.lo for r in heads])
    own = F.struct(part.alias("p"), F.lit(False).alias("g"))
    guest = F.struct(((part + 1) % max(1, m)).alias("p"), F.lit(True).alias("g"))
    both = F.when(F.col("k").isin([r.hi for r in heads]), F.array(own, guest)).otherwise(F.array(own))
    dealt = d.select("k", F.col("doc_id").cast("long").alias("doc_id"), F.explode(both).alias("_x"), "text").select("_x.p", "k", "doc_id", "_x.g", "text")
    dealt = dealt.repartitionById(n, "p").sortWithinPartitions("p", "g", F.col("k").desc())
    return dealt.select("p", "doc_id", "g", "text").mapInArrow(_compare(bins, bits), OUT)
