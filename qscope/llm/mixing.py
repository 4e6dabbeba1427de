"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional
repetitions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qscope.llm.common import BROADCAST_ROWS, Scratch, number_rows

#: Buckets by hash in which a source's documents are ordered; only the one in which the
#: fractional repetition ends is ordered document by document.
BUCKET_DIGITS = 3
WEIGHTS = (1, 2, 3)


def word_count(text) -> F.Column:
    """Words [^\\x20\\x09-\\x0D]+ of the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: int, max_epochs: int, scratch: Scratch) -> DataFrame:
    """sources(source, source_size, w) plus num, den: the source's target is num / den.

    Each round shares what the clamped sources leave by weight and clamps those whose share
    is above max_epochs times their size; the clamped set only grows, so the rounds end. A
    round is one aggregate of the sources' table; the driver holds three sums."""
    cap = F.col("source_size") * max_epochs
    num, den, clamped = total, None, -1
    while True:
        full = F.lit(False) if den is None else cap * F.lit(den) < F.col("w") * F.lit(num)
        row = sources.agg(
            F.sum(F.when(full, cap).otherwise(0)).alias("taken"),
            F.sum(F.when(full, 0).otherwise(F.col("w"))).alias("w"),
            F.count_if(full).alias("n"),
        ).first()
        if row.n == clamped or not row.w:
            break
        num, den, clamped = total - row.taken, row.w, row.n
    den = den or 1
    full = cap * F.lit(den) < F.col("w") * F.lit(num)
    return sources.select("source", "source_size", F.when(full, cap).otherwise(F.col("w") * F.lit(num)).alias("num"), F.when(full, 1).otherwise(F.lit(den)).cast("long").alias("den"))


def mix(docs: DataFrame, max_epochs: int = 3, seed: int = 0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs.

    size counts the words of a text (null and empty: 0). Sources by code point, null last,
    weigh as `weights` repeats; their targets share all words by capped water-filling. With
    r = target / source_size, each document is taken floor(r) times whole; the rest of the
    target comes from documents in the order of md5(seed, doc_id), whole until the last, of
    which only the words still needed are taken. So a source's taken words are its target
    rounded down. Sources without words have target 0. Texts are counted whole, however long;
    documents with one hash follow by doc_id and size. An empty table gives no rows; repeated
    rows count each; only doc_id, source and text are read."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sized = docs.select("doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_h"))
    sized = scratch.table(sized)
    per = scratch.table(sized.groupBy("source", F.substring("_h", 1, BUCKET_DIGITS).alias("_b")).agg(F.sum("size").alias("s")))
    sums = per.groupBy("source").agg(F.sum("s").alias("source_size")).withColumn("_null", F.col("source").isNull())
    ranked = number_rows(sums, ["_null", "source"], scratch)
    ws = F.array(*[F.lit(int(w)) for w in weights])
    ranked = ranked.select("source", "source_size", F.get(ws, (F.col("_rn") % len(weights)).cast("int")).cast("long").alias("w"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    filled = water_fill(ranked, total, max_epochs, scratch)
    whole = F.expr("num div greatest(den * source_size, 1)")
    # The words that the fractional repetition takes, rounded down.
    rest = F.expr("(num - (num div greatest(den * source_size, 1)) * den * source_size) div den")
    plan = filled.select("source", "source_size", (F.col("num") / F.col("den")).alias("target"), whole.alias("_whole"), F.when(F.col("source_size") > 0, rest).otherwise(0).alias("_rest"))
    plan = scratch.table(plan)
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edge = per.withColumn("_before", F.coalesce(F.sum("s").over(before), F.lit(0)))
    small = plan.count() * 16**BUCKET_DIGITS <= 64 * BROADCAST_ROWS
    hint = F.broadcast if small else (lambda t: t)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    edge = edge.join(hint(plan), same(edge, plan)).select(edge["source"], "_b", (F.col("_rest") - F.col("_before")).alias("_need"), "s", "source_size", "target", "_whole")
    edge = scratch.table(edge)
    keyed = sized.withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    hint = F.broadcast if edge.count() <= BROADCAST_ROWS else (lambda t: t)
    on = same(keyed, edge) & (keyed["_b"] == edge["_b"])
    joined = keyed.join(hint(edge), on).select("doc_id", keyed["source"], "size", "_h", keyed["_b"], "_need", "s", "source_size", "target", "_whole")
    inside = (F.col("_need") > 0) & (F.col("_need") < F.col("s"))
    order = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = joined.where(inside).withColumn("_at", F.coalesce(F.sum("size").over(order), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_need") - F.col("_at")))
    cols = lambda e: ["doc_id", "source", "size", "source_size", "target", (F.col("_whole") * F.col("size") + e).cast("long").alias("taken")]
    out = cut.select(*cols(extra)).unionAll(joined.where(~inside).select(*cols(F.when(F.col("_need") > 0, F.col("size")).otherwise(0))))
    return out


def mix_documents(docs: DataFrame, max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """The mix as documents: docs' columns, a document whole as often as it is taken whole
    and once cut to its first words where only a part is taken; documents taken 0 times go.
    n_chars, where there is one, is that of the text. Documents with no words, null and empty
    texts among them, stay once. Rows that repeat doc_id, source and size are paired one by
    one with what the mix takes of such rows. Columns may have any names; an empty table
    gives no rows."""
    scratch = Scratch(docs.sparkSession)
    same = ["doc_id", "source", "size"]
    taken = mix(docs, max_epochs, seed)
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    again = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    if again:
        # Which of the alike rows has which share is settled by their order.
        taken = taken.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.desc("taken"))))
        left = left.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("row"))))
        same = [*same, "nth"]
    else:
        same = ["doc_id"]
    plan = scratch.table(taken.select(*[F.col(c).alias(f"its_{c}") for c in same], "taken"))
    on = F.lit(True)
    for c in same:
        on = on & F.col(c).eqNullSafe(F.col(f"its_{c}"))
    whole, part = F.expr("if(size = 0, 1, taken div greatest(size, 1))").cast("int"), F.expr("if(size = 0, 0, taken % greatest(size, 1))").cast("int")
    none = F.array().cast("array<int>")
    pieces = F.concat(F.when(whole > 0, F.array_repeat(F.lit(-1), whole)).otherwise(none), F.when(part > 0, F.array(part)).otherwise(none))
    left = left.join(plan, on).select("row", F.explode(pieces).alias("words"))
    words = F.expr("regexp_extract_all(row.text, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0)")
    first = F.array_join(F.slice(words, F.lit(1), F.col("words")), "")
    left = left.withColumn("new", F.when(F.col("words") > 0, first).otherwise(F.col("row.text")))
    changed = {"text": F.col("new").alias("text"), "n_chars": F.coalesce(F.length("new"), F.lit(0)).cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in docs.columns else None}
    return left.select(*[F.col(f"row.`{c}`") if changed.get(c) is None else changed[c] for c in docs.columns])


#: DuckDB, for the query over `documents` with the default parameters.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS w FROM s),
c AS (SELECT *, sum(3 * source_size) OVER o AS capped, sum(w) OVER o AS used,
             sum(source_size) OVER () AS total, sum(w) OVER () AS allw
      FROM r WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, CAST(total - coalesce(capped, 0) AS BIGINT) AS num, CAST(allw - coalesce(used, 0) AS BIGINT) AS den FROM c),
lam AS (SELECT num, den FROM e WHERE 3 * source_size * den >= w * num ORDER BY 3.0 * source_size / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN 3 * source_size * lam.den < w * lam.num THEN 3 * source_size ELSE w * lam.num END AS num,
             CASE WHEN 3 * source_size * lam.den < w * lam.num THEN 1 ELSE lam.den END AS den FROM r, lam),
p AS (SELECT source, source_size, CAST(num AS DOUBLE) / den AS target, num // greatest(den * source_size, 1) AS whole,
             CASE WHEN source_size > 0 THEN (num - (num // greatest(den * source_size, 1)) * den * source_size) // den ELSE 0 END AS rest FROM t),
q AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT q.doc_id, q.size, p.source_size, p.target,
       CAST(p.whole * q.size + greatest(0, least(q.size, p.rest - q.before)) AS BIGINT) AS taken, q.source
FROM q JOIN p ON q.source IS NOT DISTINCT FROM p.source
"""
