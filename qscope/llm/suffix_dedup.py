"""Suffix-array removal of repeated substrings.

A string of SPAN bytes repeats if it also starts earlier in the corpus. Its GRAM-byte pieces
have a least hash, the same wherever the string stands; so a document's maximal runs of
windows with one least hash are cut out, SPAN - 1 bytes longer than the run, and runs with
one hash meet in one shard. A run whose hash no other run has, and whose gram stands in it
once, can't repeat and is left out. A hash that is frequent in a sample of documents is
split: its runs are cut again by the least hash of their LONG-byte pieces.

Equal documents and equal runs are one: the later ones repeat as a whole. Equal runs that a
task meets together are compared there, byte by byte; of the others, all but the first send
a 128-bit digest in place of their bytes.
A shard concatenates its distinct runs in corpus order and builds their suffix array by
induced sorting; where neighbours in the array agree on SPAN bytes, all but the earliest
are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qscope.llm.common import Poly, Scratch, as_long, copies_of, keyed, lean, mix, only, packed, text_bytes, unpacked
from qscope.llm.suffix_array import common_prefixes, suffix_array

SPAN, GRAM, LONG = 100, 32, 96
#: Bytes of distinct runs from which a shard's array is built; a hash's runs stay together.
SHARD_BYTES = 1 << 20
#: Window starts that are hashed at once; some twenty 64-bit arrays of that length are held.
SEGMENT = 1 << 18
#: Runs sent at once, and in a range of hashes.
SENT, RANGE = 1 << 19, 1 << 17
#: Documents in which frequent hashes are looked for: LOOKED_AT to twice as many, or one in
#: LEAST_SHARE where that is more; and how many runs of all documents make a hash frequent. So
#: the driver holds at most one of 256 of the sample's hashes.
LOOKED_AT, LEAST_SHARE, HOT_RUNS = 4096, 2048, 1 << 19

PLACE = np.uint64((1 << 21) - 1)
POLY_A, POLY_B = Poly(31), Poly(32)


def _segments(off: np.ndarray, i: int, j: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of window starts, for documents i..j-1, of bounded length."""
    a, end = int(off[i]), int(off[j])
    while a < end:
        yield a, min(end, a + SEGMENT)
        a += SEGMENT


def runs(data: np.ndarray, off: np.ndarray, hot: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, document, start, windows, twice, hash of the bytes) of the runs of all
    documents, in order, a segment at a time. twice: the hash's gram stands in the run more
    than once, so the run may repeat itself. Runs of the hashes in hot are cut again."""
    n = len(off) - 1
    for a, b in _segments(off, 0, n):
        x = data[a : min(int(off[n]), b + SPAN - 1)]
        if len(x) < SPAN:
            continue
        prefix = POLY_A.prefix(x)
        start = np.arange(min(b - a, len(x) - SPAN + 1)) + a
        doc = np.searchsorted(off, start, "right") - 1
        ok = start + SPAN <= off[doc + 1]
        start, doc = start[ok], doc[ok]
        if not len(start):
            continue
        least, first = _least(prefix, GRAM)
        least, first = least[start - a], first[start - a]
        if hot is not None and len(hot):
            at = np.minimum(np.searchsorted(hot, least), len(hot) - 1)
            often = hot[at] == least
            if often.any():
                long, place = _least(prefix, LONG)
                least = np.where(often, mix(least ^ long[start - a]), least)
                first = np.where(often, place[start - a], first)
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])
        edge = np.flatnonzero(new)
        moved = np.concatenate([[0], np.cumsum(first[1:] != first[:-1])])
        last = np.append(edge[1:], len(start)) - 1
        begin = start[edge] - a
        content = mix(POLY_A.ranges(prefix, begin, start[last] - a + SPAN) + (last - edge).astype(np.uint64))
        yield least[edge], doc[edge], start[edge] - off[doc[edge]], last - edge + 1, moved[last] > moved[edge], content


def _least(prefix: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of SPAN bytes, its pieces' least hash and where that piece starts; the
    first of equal pieces is taken."""
    at = np.arange(len(prefix) - gram)
    hashes = mix(POLY_A.ranges(prefix, at, at + gram))
    # The place in the low bits makes the first of equal grams the least.
    least = (hashes & ~PLACE) | at.astype(np.uint64)
    span, width = 1, SPAN - gram + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    first = (least & PLACE).astype(np.int64)
    # A least hash is a small number; mixed again, it falls into any range of keys.
    return mix(hashes[first]), first


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, c): hashes of runs in some texts, and how many runs have them."""
    for batch in batches:
        for key, *_ in runs(*text_bytes(batch.column(0))):
            keys, times = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(keys)), pa.array(times)], names=["key", "c"])


def frequent(docs: DataFrame, n: int, hot_runs: int = HOT_RUNS) -> tuple[np.ndarray, int]:
    """(sorted hashes that are frequent, about how many runs docs(k, text) has)."""
    every = max(1, min(LEAST_SHARE, n // LOOKED_AT))
    least = max(2, hot_runs // every)
    seen = docs.where(F.expr(f"pmod(xxhash64(k), {every}) = 0")).select("text").mapInArrow(lean(_look), "key long, c long")
    found = seen.groupBy("key").agg(F.sum("c").alias("c")).agg(F.sum("c"), F.collect_list(F.when(F.col("c") >= least, F.col("key")))).first()
    return np.sort(np.array(found[1], np.int64).view(np.uint64)), (found[0] or 0) * every


#: What becomes of a run: its bytes go to a shard; its digest does, as its bytes are known
#: from an earlier run; its digest does, as it is the first of equal ones and nothing else
#: shares its hash; it is cut as a whole.
BYTES, COPY, FIRST, CUT = 0, 1, 2, 3
SENT_COLUMNS = "r int, cut boolean, key binary, k binary, at binary, content binary"
FOUND = "k long, key long, at long, kind int"


def _place(start: np.ndarray, twice: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A run's start, mark and windows in one long."""
    return start << 24 | twice.astype(np.int64) << 23 | count


def _send(shared, ranges: int):
    """mapInArrow: (k, text) to arrays of runs by range of their hashes. Of equal runs in a
    segment the first goes on, the others are cut."""

    def rows(held: list) -> list[tuple]:
        key, k, at, content = (np.concatenate(x) for x in zip(*held, strict=True))
        r = ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(r.astype(np.uint16) if ranges < 1 << 16 else r, kind="stable")
        key, k, at, content = key[order], k[order], at[order], content[order]
        edges = np.searchsorted(r[order], np.arange(ranges + 1))
        return [(i, False, key[x:y].tobytes(), packed(k[x:y]), at[x:y].tobytes(), content[x:y].tobytes()) for i, x, y in ((i, edges[i], edges[i + 1]) for i in np.flatnonzero(np.diff(edges)).tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = text_bytes(batch.column(1))
            for key, doc, start, count, twice, content in runs(data, off, shared.value):
                k, at = ids[doc], _place(start, twice, count)
                later = _later(data, off[doc] + start, count, k, start, key, content)
                if len(later):
                    turn += 1
                    yield _sent([((turn * 7919) % ranges, True, b"", k[later].tobytes(), at[later].tobytes(), b"")])
                    stay = np.ones(len(key), bool)
                    stay[later] = False
                    key, k, at, content = key[stay], k[stay], at[stay], content[stay]
                held.append((key, k, at, content))
                size += len(key)
                if size >= SENT:
                    yield _sent(rows(held))
                    held, size = [], 0
        if held:
            yield _sent(rows(held))

    return run


def _later(data: np.ndarray, begin: np.ndarray, count: np.ndarray, k: np.ndarray, start: np.ndarray, key: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Which of some runs have the same bytes, as compared here, as the first of those with
    their hashes."""
    if not len(key):
        return np.zeros(0, np.int64)
    order = np.argsort(content, kind="stable")
    c = content[order]
    if not (c[1:] == c[:-1]).any():
        return np.zeros(0, np.int64)
    order = np.lexsort((start, k, key, count, content))
    new = np.ones(len(order), bool)
    for x in (content, key, count):
        y = x[order]
        new[1:] &= y[1:] == y[:-1]
    new[1:] = ~new[1:]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    copy = np.flatnonzero(~new)
    whole = memoryview(data)
    same = [bytes(whole[i : i + n]) == bytes(whole[j : j + n]) for i, j, n in zip(begin[order[copy]].tolist(), begin[first[copy]].tolist(), (count[order[copy]] + SPAN - 1).tolist(), strict=True)]
    return order[copy[np.array(same, bool)]]


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["r", "cut", "key", "k", "at", "content"])


def _found(table: pa.Table) -> pa.Table:
    """A range's runs to those that may repeat, and what becomes of them."""
    cut, sent = table.filter(table.column("cut")), table.filter(pc.invert(table.column("cut")))
    whole = lambda name, kind: np.frombuffer(b"".join(sent.column(name).to_pylist()), kind)
    key, at, content = whole("key", np.uint64), whole("at", np.int64), whole("content", np.uint64)
    k = np.concatenate([np.zeros(0, np.int64), *[unpacked(x, len(y) // 8) for x, y in zip(sent.column("k").to_pylist(), sent.column("at").to_pylist(), strict=True)]])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    number = np.diff(np.append(first, len(key)))
    twice = (at[order] >> 23 & 1).astype(bool)
    # Hashes of one run only, whose gram stands there once, go first.
    held = np.repeat(number, number) > 1
    held |= twice
    order, key, twice = order[held], key[held], twice[held]
    k, at, content = k[order], at[order], content[order]
    inner = np.lexsort((at >> 24, k, content, key))
    key, k, at, content, twice = key[inner], k[inner], at[inner], content[inner], twice[inner]
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new = new_key.copy()
    new[1:] |= content[1:] != content[:-1]
    group = np.cumsum(new_key) - 1
    contents = np.bincount(group[new], minlength=int(new_key.sum()))[group]
    kind = np.where(~new, COPY, np.where((contents > 1) | twice, BYTES, FIRST))
    gone = [np.frombuffer(b"".join(cut.column(c).to_pylist()), np.int64) for c in ("k", "at")]
    return pa.table([pa.array(np.concatenate([k, gone[0]])), pa.array(np.concatenate([as_long(key), np.zeros(len(gone[0]), np.int64)])), pa.array(np.concatenate([at, gone[1]])), pa.array(np.concatenate([kind, np.full(len(gone[0]), CUT)]).astype(np.int32))], names=["k", "key", "at", "kind"])


PIECES = "key long, k long, at long, kind int, piece binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, text, runs) to the runs' bytes or digests."""
    for batch in batches:
        data, off = text_bytes(batch.column(1))
        ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        bounds = lists.offsets.to_numpy()
        key, at, kind = (np.asarray(lists.values.field(c))[bounds[0] : bounds[-1]] for c in ("key", "at", "kind"))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        begin = off[owner] + (at >> 24)
        end = begin + (at & ((1 << 23) - 1)) + SPAN - 1
        whole = memoryview(data)
        for a in range(0, len(key), 1 << 14):
            b = a + (1 << 14)
            held = [bytes(whole[i:j]) if w == BYTES else digest(whole[i:j]) for i, j, w in zip(begin[a:b].tolist(), end[a:b].tolist(), kind[a:b].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(ids[owner[a:b]]), pa.array(at[a:b]), pa.array(kind[a:b]), pa.array(held, pa.binary())], names=["key", "k", "at", "kind", "piece"])


def digest(piece: bytes | memoryview) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def repeated(pieces: list[bytes]) -> list[np.ndarray]:
    """For each of some distinct pieces in corpus order, which of its windows start earlier
    in another piece or in itself."""
    size = np.array([len(p) for p in pieces])
    t = np.zeros(int(size.sum()) + len(pieces) + 1, np.uint16)
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    body = np.ones(len(t), bool)
    body[begin + size] = False
    body[-1] = False
    t[body] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 2
    t[begin + size] = 1
    sa = suffix_array(t)
    agree = common_prefixes(t, sa)[sa] >= SPAN
    # Runs of the array in which neighbours agree are the occurrences of one window.
    group = np.cumsum(~agree)
    first = np.full(int(group[-1]) + 1, len(t), np.int64)
    np.minimum.at(first, group, sa.astype(np.int64))
    later = np.zeros(len(t), bool)
    later[sa] = first[group] < sa
    return [later[b : b + s - SPAN + 1] for b, s in zip(begin.tolist(), size.tolist(), strict=True)]


CUTS = "k long, s long, e long"


def _cuts(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k", "s", "e"])


def _shard(rows: list[tuple[int, int, int, int, bytes]]) -> list[tuple[int, int, int]]:
    """Removed byte ranges of runs (k, at, key, kind, bytes or digest)."""
    rows.sort(key=lambda r: (r[0], r[1] >> 24))
    firsts: set[tuple[int, bytes]] = set()
    held: dict[bytes, tuple[int, int]] = {}
    out: list[tuple[int, int, int]] = []
    copies = []
    for k, at, key, kind, piece in rows:
        start, windows = at >> 24, at & ((1 << 23) - 1)
        name = key, digest(piece) if kind == BYTES else piece
        if name in firsts:
            out.append((k, start, start + windows + SPAN - 1))
            continue
        firsts.add(name)
        if kind == BYTES and piece not in held:
            held[piece] = k, start
        elif kind == COPY:
            copies.append(name)
    if copies:
        raise RuntimeError("runs with equal 64-bit hashes differ")
    if not held:
        return out
    for (k, start), later in zip(held.values(), repeated(list(held)), strict=True):
        if later.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], later.view(np.int8), [0]])))
            out.extend((k, start + int(a), start + int(b) - 1 + SPAN) for a, b in zip(edge[::2], edge[1::2], strict=True))
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by hash to removed ranges, an array for every SHARD_BYTES or more."""
    rows: list[tuple[int, int, int, int, bytes]] = []
    size, last = 0, None
    for batch in batches:
        for key, k, at, kind, piece in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if size >= SHARD_BYTES and key != last:
                yield _cuts(_shard(rows))
                rows, size = [], 0
            rows.append((k, at, key, kind, piece))
            size += len(piece)
            last = key
    if rows:
        yield _cuts(_shard(rows))


def cuts(d: DataFrame, scratch: Scratch, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(k, s, e): byte ranges of documents (k, text) that are removed; they may overlap. A
    hash with hot_runs runs or more, by the sample, is split; that changes no range."""
    of, _ = copies_of(d, scratch)
    again = of.where("k != rep")
    texts = only(d, again.select("k"), "k", "left_anti")
    hot, total = frequent(texts, texts.count(), hot_runs)
    ranges = max(1, -(-total // RANGE))
    shared = d.sparkSession.sparkContext.broadcast(hot)
    sent = texts.mapInArrow(lean(_send(shared, ranges)), SENT_COLUMNS)
    found = scratch.table(sent.groupBy("r").applyInArrow(_found, FOUND))
    lists = found.where(F.col("kind") != CUT).groupBy("k").agg(F.collect_list(F.struct("key", "at", "kind")).alias("runs"))
    pieces = texts.join(lists.hint("shuffle_hash"), "k").select("k", "text", "runs").mapInArrow(lean(_pieces), PIECES)
    out = scratch.table(pieces.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_shards), CUTS))
    start = F.shiftright("at", 24)
    cut = found.where(F.col("kind") == CUT).select("k", start.alias("s"), (start + F.col("at").bitwiseAND(F.lit((1 << 23) - 1)) + SPAN - 1).alias("e"))
    # An equal document that comes later goes as a whole, if it is long enough to hold a string.
    longer = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    gone = only(d, again.select("k"), "k", "left_semi").where(longer >= SPAN).select("k", F.lit(0).cast("long").alias("s"), longer.alias("e"))
    return out.unionAll(cut).unionAll(gone)


def _merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((r["s"], r["e"]) for r in ranges or []):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in spans:
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]])


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
ROWS = 256


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part, out = batch.slice(a, ROWS), []
            for doc, text, ranges in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                raw, spans = (text or "").encode(), _merged(ranges)
                out.append((doc, len(raw), sum(e - s for s, e in spans), len(spans), hashlib.sha256(_kept(raw, spans)).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _by_document(found: DataFrame) -> DataFrame:
    return found.groupBy("k").agg(F.collect_list(F.struct("s", "e")).alias("ranges")).hint("shuffle_hash")


def dedup(docs: DataFrame, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Texts are UTF-8 bytes, null is empty; each byte goes that is covered by a SPAN-byte
    string which also starts earlier: in a smaller doc_id, or in the same document earlier.
    Strings are judged on the input. Texts shorter than SPAN lose nothing. Rows that repeat
    a doc_id, or have none, are documents of their own, ordered by text, nulls first. Texts
    of any length are taken whole, in segments whose windows overlap none of the next. An
    empty table gives no rows; extra columns are ignored."""
    scratch = Scratch(docs.sparkSession)
    d = keyed(docs, scratch)
    found = cuts(d.select("k", "text"), scratch, hot_runs)
    return d.join(_by_document(found), "k", "left").select(F.col("doc_id").cast("long"), "text", "ranges").mapInArrow(_digest, DIGESTS)


def trimmed(text: str, ranges: list[dict] | None) -> str:
    """The text without the removed ranges; a code point goes only if all its bytes do."""
    raw, inner = text.encode(), []
    for s, e in _merged(ranges):
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        inner.append((s, e))
    return _kept(raw, inner).decode()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated substrings cut out of text; documents stay, n_chars follows.
    Null and short texts stay as they are. Of rows that repeat doc_id and text, the first
    keeps what no smaller document has. Long texts are taken whole. Columns may have any
    names; an empty table gives no rows."""
    scratch = Scratch(docs.sparkSession)
    d = keyed(docs, scratch)
    ranges = _by_document(cuts(d.select("k", "text"), scratch))

    @F.udf("string")
    def cut(text, found):
        return text if text is None or not found else trimmed(text, found)

    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    if d._renumbered:
        # Rows alike in doc_id and text: the first of them keeps most, so take them in order.
        same = Window.partitionBy("doc_id", "text")
        allk = d.select("k", "doc_id", "text").withColumn("nth", F.row_number().over(same.orderBy("k"))).join(ranges, "k", "left")
        left = left.withColumn("nth", F.row_number().over(same.orderBy(F.xxhash64("row"))))
        on = left["doc_id"].eqNullSafe(allk["doc_id"]) & left["text"].eqNullSafe(allk["text"]) & (left["nth"] == allk["nth"])
        joined = left.join(allk, on, "left").select("row", left["text"], "ranges")
    else:
        joined = left.join(ranges, left["doc_id"].cast("long") == ranges["k"], "left").select("row", "text", "ranges")
    out = joined.withColumn("new", F.when(F.col("ranges").isNull(), F.col("text")).otherwise(cut("text", "ranges")))
    changed = {"text": F.col("new").alias("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("ranges").isNull(), F.col("row.n_chars")).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")) for c in docs.columns])
