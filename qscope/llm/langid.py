"""Language identification by hyperdimensional profiles.

Every letter symbol has a random +1/-1 vector; an n-gram's vector is the product of its
letters' vectors, each permuted (rolled) by its place; a text's vector is the sum of its
n-grams'. A language's prototype is the mean direction of its training texts, less the mean
of all prototypes; a text goes to the prototype with the greatest cosine.

The sum over a text's n-grams times a prototype is a sum of (n-gram vector times prototype),
so a worker tabulates those products once and a text costs one lookup per letter. The norm
of a text's vector comes from its n-gram counts: the vectors are orthogonal but for noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qscope.llm.common import lean, mix, stream

SYMBOLS, GRAM = 64, 3
DIMENSIONS = 2048
#: Texts a language that are learnt from, on average, at most; a documented bound.
SAMPLE_TEXTS = 4000
UND = "und"
CHUNK_CHARS = 1 << 18

_symbols: dict[int, np.ndarray] = {}


def symbol_table() -> np.ndarray:
    """Code point to symbol: 0 is no letter, a-z are 1-26, other letters share the rest by a
    hash. Letters with cases count as their lower case where that is one code point."""
    if not _symbols:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                o = ord(low) if len(low) == 1 else c
                table[c] = o - 96 if 97 <= o <= 122 else 27 + (o * 2654435761 >> 7) % (SYMBOLS - 27)
        _symbols[0] = table
    return _symbols[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram codes, counts) of a whole text; runs of other characters are one boundary."""
    table, found, tail = symbol_table(), [], np.zeros(1, np.int64)
    for a in range(0, len(text), CHUNK_CHARS):
        points = np.frombuffer(text[a : a + CHUNK_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        s = np.concatenate([tail, table[points].astype(np.int64)])
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
        tail = s[-2:]
        found.append((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])
    end = np.concatenate([tail, [0]])
    if len(end) >= 3 and end[-2] != 0:
        found.append((end[:-2] * SYMBOLS + end[1:-1]) * SYMBOLS + end[2:])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.concatenate(found)
    # Grams without a letter are left out.
    few = (grams % SYMBOLS != 0).astype(int) + (grams // SYMBOLS % SYMBOLS != 0) + (grams // SYMBOLS**2 != 0)
    return np.unique(grams[few >= 1], return_counts=True)


def letters(seed: int, dimensions: int) -> list[np.ndarray]:
    """For each place in an n-gram, the letters' vectors permuted for it."""
    bits = (mix(stream(seed, SYMBOLS * dimensions)) & np.uint64(1)).astype(np.float32).reshape(SYMBOLS, dimensions)
    base = bits * 2 - 1
    return [np.roll(base, GRAM - 1 - i, axis=1) for i in range(GRAM)]


def bundle(counts: np.ndarray, seed: int, dimensions: int) -> np.ndarray:
    """The sum of n-gram vectors for a dense count of all codes."""
    a, b, c = letters(seed, dimensions)
    third = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float32)
    out = np.zeros(dimensions, np.float64)
    for i in range(SYMBOLS):
        if third[i].any():
            out += (a[i] * b * (third[i] @ c)).sum(0, dtype=np.float64)
    return out


def products(prototypes: np.ndarray, seed: int, dimensions: int) -> np.ndarray:
    """For every n-gram code, its vector times every prototype."""
    a, b, c = letters(seed, dimensions)
    out = np.zeros((SYMBOLS, SYMBOLS, SYMBOLS, len(prototypes)), np.float32)
    for j, p in enumerate(prototypes.astype(np.float32)):
        for i in range(SYMBOLS):
            out[i, :, :, j] = (a[i] * b * p) @ c.T
    return out.reshape(-1, len(prototypes))


class Profiles:
    """Prototypes by language; pickles small, tabulates on first use."""

    def __init__(self, langs: list[str], sums: np.ndarray, seed: int, dimensions: int):
        self.langs, self.seed, self.dimensions = langs, seed, dimensions
        unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12) if len(sums) else sums
        self.center = unit.mean(0, keepdims=True) if len(unit) > 1 else np.zeros((1, dimensions))
        unit = unit - self.center
        self.prototypes = (unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self._table = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = products(self.prototypes, self.seed, self.dimensions)
        return self._table

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = gram_counts(text or "")
        if not len(grams) or not self.langs:
            return UND, 0.0
        weight = np.sqrt(counts)
        dots = weight @ self.table()[grams]
        norm = np.sqrt(self.dimensions * float(counts.sum()))
        best = int(np.argmax(dots))
        return self.langs[best], float(min(1.0, max(0.0, 0.5 + 0.5 * dots[best] / max(norm, 1e-12))))


def learn(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, seed: int = 0, dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes from rows with a text and a lang. Each language is learnt from all its
    texts or, beyond sample_texts, from a share of them chosen by a hash of the text, about
    that many: the classifier's documented bound. The driver gets one vector a language and
    task, of a bounded number of tasks."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles([], np.zeros((0, dimensions)), seed, dimensions)
    share = F.create_map(*[v for k, n in sizes.items() for v in (F.lit(k), F.lit(min(1.0, sample_texts / n)))])
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(draw < share[F.col("lang")]).repartition(min(16, 1 + len(sizes) * sample_texts // 1000), F.xxhash64("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, counts = gram_counts(text)
                if len(grams):
                    # Each text weighs the same; roots keep common n-grams from ruling.
                    w = np.sqrt(counts)
                    sums.setdefault(lang, np.zeros(SYMBOLS**GRAM))[grams] += w / np.sqrt((w * w).sum())
        out = [(k, bundle(v, seed, dimensions).tobytes()) for k, v in sums.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out]), pa.array([v for _, v in out], pa.binary())], names=["lang", "v"])

    total: dict[str, np.ndarray] = {}
    for r in picked.mapInArrow(lean(count), "lang string, v binary").collect():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.v, np.float64)
    langs = sorted(total)
    return Profiles(langs, np.array([total[k] for k in langs]).reshape(len(langs), dimensions), seed, dimensions)


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predictor(spark, profiles: Profiles):
    """A function of a text column that gives (lang_pred, score)."""
    shared = spark.sparkContext.broadcast(profiles)

    @F.pandas_udf(PREDICTION)
    def run(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return run


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % 5 == 0


def identify(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, seed: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    Learns from the rows that aren't held out (crc32 of doc_id as text, modulo 5, is not 0; a
    null doc_id is held out) and predicts from the text alone. Null texts and texts without a
    letter are `und` with score 0, as is all if there is nothing to learn from. score maps the
    cosine to 0..1. Ties go to the first language by name. Repeated rows are predicted alike;
    an empty table gives no rows; extra columns are ignored."""
    d = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id"))
    profiles = learn(d.where(~F.col("held_out")), sample_texts, seed)
    out = d.select("doc_id", "held_out", predictor(docs.sparkSession, profiles)("text").alias("_p"))
    return out.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def reject_unknown(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """docs without the rows whose language can't be told (`und`): null texts and texts without
    a letter; all others stay, whatever their length. Repeated rows go or stay alike. Columns
    may have any names; an empty table gives no rows."""
    profiles = learn(docs, sample_texts)
    if not profiles.langs:
        # Nothing is labelled: a text is rejected only if it has no letter.
        return docs.where(F.col("text").rlike("\\p{L}"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = docs.select(row, predictor(docs.sparkSession, profiles)("text").alias("found"))
    return found.where(F.col("found.lang_pred") != UND).select("row.*")
