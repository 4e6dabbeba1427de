"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global
row numbers. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qscope.llm.common import Scratch, number_rows

ROUNDS = 6
PRIME = 2147483647
#: Passes that the walk makes at most. Values outside are fewer than the root of the row
#: count: up to 4096 rows no walk is longer, beyond it each pass ends it with odds over 63/64.
WALK = 64


def keys(seed: int) -> list[tuple[int, int]]:
    """A multiplier and an addend below PRIME for each round."""
    out, x = [], (seed * 2654435761 + 97531) % PRIME
    for _ in range(ROUNDS):
        a = (x * 48271 + 11) % PRIME
        x = (a * 69621 + 7) % PRIME
        out.append((a | 1, x))
    return out


def sides(n: int) -> tuple[int, int]:
    """The two halves' ranges: a * b >= n, by less than a."""
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    return a, max(1, -(-n // a))


def place(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of a row number, computed without the data."""
    (a, b), x = sides(n), row
    while True:
        left, right = x % a, x // a
        for i, (m, c) in enumerate(keys(seed)):
            if i % 2 == 0:
                left = (left + (right % PRIME * m + c) % PRIME // 7) % a
            else:
                right = (right + (left % PRIME * m + c) % PRIME // 7) % b
        x = right * a + left
        if x < n:
            return x % shards, x // shards


def permute(df: DataFrame, row: str, n: int, seed: int, out: str) -> DataFrame:
    """df plus the permuted row number. Each round is a projection; the few values that
    fall outside walk on in a fold."""
    a, b = sides(n)
    df = df.withColumn("_l", F.expr(f"{row} % {a}L")).withColumn("_r", F.expr(f"{row} div {a}L"))
    for i, (m, c) in enumerate(keys(seed)):
        if i % 2 == 0:
            df = df.withColumn("_l", F.expr(f"(_l + (_r % {PRIME}L * {m}L + {c}L) % {PRIME}L div 7L) % {a}L"))
        else:
            df = df.withColumn("_r", F.expr(f"(_r + (_l % {PRIME}L * {m}L + {c}L) % {PRIME}L div 7L) % {b}L"))
    muls, adds = (f"array({', '.join(f'{k[j]}L' for k in keys(seed))})" for j in (0, 1))
    return df.withColumn(out, F.expr(f"if(_r * {a}L + _l < {n}L, _r * {a}L + _l, {_fold(a, b, n, muls, adds)})")).drop("_l", "_r")


def _fold(a: int, b: int, n: int, muls: str, adds: str) -> str:
    """Further passes: d is set at the end of the pass in which the value falls inside."""
    f = f"(if(i % 2 = 0, s.r, s.l) % {PRIME}L * get({muls}, i % {ROUNDS}) + get({adds}, i % {ROUNDS})) % {PRIME}L div 7L"
    left, right = f"if(i % 2 = 0, (s.l + {f}) % {a}L, s.l)", f"if(i % 2 = 0, s.r, (s.r + {f}) % {b}L)"
    moved = f"named_struct('l', {left}, 'r', {right}, 'd', i % {ROUNDS} = {ROUNDS - 1} AND ({right}) * {a}L + ({left}) < {n}L)"
    last = f"if(s.d, s.r * {a}L + s.l, cast(raise_error('a walk of over {WALK} passes') as bigint))"
    return f"aggregate(sequence(0, {WALK * ROUNDS - 1}), named_struct('l', _l, 'r', _r, 'd', false), (s, i) -> if(s.d, s, {moved}), s -> {last})"


def shard(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows are numbered by (doc_id, crc32, size), nulls first; the permuted number gives the
    shard (its remainder by the shard count) and the slot (the quotient). So shards' counts
    differ by at most one (law "rows"), slots have no gaps, and place() finds any row
    without reading data. size is the text's UTF-8 bytes plus 1 (null: 1), text_crc32 that
    of its bytes (null: 0). Repeated rows get places of their own; an empty table gives no
    rows; only doc_id and text are read."""
    scratch = Scratch(docs.sparkSession)
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    d = d.select("doc_id", (F.octet_length("_t") + 1).cast("long").alias("size"), F.crc32(F.encode("_t", "UTF-8")).alias("text_crc32"))
    rows = number_rows(d, ["doc_id", "text_crc32", "size"], scratch)
    n = max(1, rows._total)
    p = permute(rows, "_rn", n, seed, "_p")
    return p.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.expr(f"cast(_p % {shards} as int)").alias("shard"), F.expr(f"_p div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
