"""Mixing sources to target weights: hash order, distributed prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: A word of the size: a run of anything but ASCII white space.
WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.expr(f"coalesce(regexp_count(`{text}`, '{WORD}'), 0)").cast("bigint")


#: Weight of the i-th source (from 0) by code point, null last: the given numbers, repeating.
TARGETS = """
WITH s AS (SELECT src, sum(size) AS source_size FROM {sized} GROUP BY src),
r AS (SELECT src, source_size, row_number() OVER (ORDER BY src NULLS LAST) - 1 AS i FROM s),
w AS (SELECT src, source_size, CAST({weights} AS DOUBLE) AS w, CAST({cap} * source_size AS DOUBLE) AS cap FROM r),
o AS (SELECT *, CAST({share} AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
  - (sum(cap) OVER (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cap) AS left_over,
  sum(w) OVER (ORDER BY cap / w DESC, src DESC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w_left FROM w),
l AS (SELECT *, coalesce(max(CASE WHEN cap / w > left_over / w_left THEN left_over / w_left END) OVER (), max(cap / w) OVER ()) AS lam FROM o)
SELECT src, source_size, least(cap, lam * w) AS target FROM l
"""


def targets_sql(sized: str, weights=(5, 2, 1), share: float = 1.5, cap: int = 2) -> str:
    """SQL, for Spark and others, of each source's target.

    Targets are the weighted shares of ``share`` times all sizes, held at ``cap``
    times the source's size; what is above is shared anew by weight. Sorting by
    cap over weight gives that level in one pass instead of by rounds. It sees a
    row for each source, so its one-partition windows are as long as the list of
    weights, not as the corpus.
    """
    case = "CASE i % {n} {w} END".format(n=len(weights), w=" ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(weights)))
    return TARGETS.format(sized=sized, weights=case, share=share, cap=cap)


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), share=1.5, cap=2,
        seed="mix", fine: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken, epochs) for each row of ``docs``.

    Within a source, documents stand in the order of md5(seed, id), ties by size.
    The whole source is taken floor(target / source size) times; of one more
    epoch, those documents whose middle lies before the rest of the budget. So
    documents are whole, no document counts over ``cap`` times, and a source misses
    its budget by half of one document at most. Prefix sums are made in two
    levels: sums by the first ``fine`` hex digits of the hash, added up within
    each source (16**fine rows at most), and running sums within those groups. So
    a source with most of the rows is dealt over 16**fine groups.

    Null text: size 0. Null source: a source of its own, last. Repeated rows are
    separate documents, of which equal ones may stand in any order, which changes
    no figure of theirs but which of them is taken. No rows: no rows.
    """
    run = _placed(docs, id_col, text_col, source_col, weights, share, cap, seed, fine)
    return run.selectExpr(f"id AS `{id_col}`", "size", "source_size", "target", f"least(epochs, {cap}) * size AS taken", f"least(epochs, {cap}) AS epochs")


def order_key(id_col: str, seed: str = "mix") -> Column:
    """What documents of a source stand in the order of, before their size."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _placed(docs, id_col, text_col, source_col, weights, share, cap, seed, fine) -> DataFrame:
    """(id, src, h, size, source_size, target, whole, epochs): of each row, the epochs that all of its source have, and its own."""
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), word_count(text_col).alias("size"), order_key(id_col, seed).alias("h"))
    sized = materialise(sized, "sized").withColumn("g", F.substring("h", 1, fine))  # words are counted once
    groups = sized.groupBy("src", "g").agg(F.sum("size").alias("size"))
    tgt = spark.sql(targets_sql("{sized}", weights, share, cap), sized=groups)
    before = groups.select("src", "g", F.expr("sum(size) OVER (PARTITION BY src ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size").alias("before"))
    plan = before.join(tgt, before["src"].eqNullSafe(tgt["src"])).select(before["src"], "g", "before", "source_size", "target")
    plan = plan.withColumnsRenamed({"src": "src2", "g": "g2"})
    run = sized.withColumn("upto", F.expr("sum(size) OVER (PARTITION BY src, g ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    out = run.join(plan, run["src"].eqNullSafe(plan["src2"]) & (run["g"] == plan["g2"]), "left")
    out = out.selectExpr("id", "src", "h", "size", "source_size", "target", "before + upto - size AS first", "CAST(CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS BIGINT) AS whole")
    return out.selectExpr("id", "src", "h", "size", "source_size", "target", "whole", "CAST(whole + CASE WHEN source_size > 0 AND size > 0 AND first + size / 2D <= target - whole * source_size THEN 1 ELSE 0 END AS BIGINT) AS epochs")


def repeat(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), share=1.5, cap=2, seed="mix", fine: int = 3) -> DataFrame:
    """``docs``, each row as often as ``mix`` takes it.

    Within a source the extra epoch is a prefix of the order, so it ends at one
    place (order key, size): a row for each source is all that the texts are joined
    with, and they aren't shuffled. Where several rows stand at that place (they
    share id and size), as many of them as ``mix`` takes are, in the order of their texts.
    """
    run = _placed(docs, id_col, text_col, source_col, weights, share, cap, seed, fine)
    run = materialise(run.select("src", "h", "size", "whole", "epochs"), "placed")
    ends = run.groupBy("src").agg(F.max("whole").alias("__whole"), F.max(F.when(F.col("epochs") > F.col("whole"), F.struct("h", "size"))).alias("__end"))
    ends = materialise(ends.select(F.col("src").alias("__src"), "__whole", F.col("__end.h").alias("__end_h"), F.col("__end.size").alias("__end_size")), "ends")
    at_end = run.join(ends, run["src"].eqNullSafe(F.col("__src")) & (F.col("h") == F.col("__end_h")) & (F.col("size") == F.col("__end_size")))
    tied = at_end.groupBy("src").agg(F.count("*").alias("n"), F.sum(F.col("epochs") - F.col("whole")).alias("__extra")).where("n > 1").select(F.col("src").alias("__tied"), "__extra")
    tied = materialise(tied, "tied")
    names = docs.columns
    out = docs.withColumn("__h", order_key(id_col, seed)).withColumn("__n", word_count(text_col))
    out = out.join(ends, F.col(source_col).cast("string").eqNullSafe(F.col("__src")))
    place, end = F.struct(F.col("__h").alias("h"), F.col("__n").alias("n")), F.struct(F.col("__end_h").alias("h"), F.col("__end_size").alias("n"))
    more = F.when((F.col("__n") > 0) & F.col("__end_h").isNotNull() & (place <= end), 1).otherwise(0)
    if not tied.isEmpty():
        here = out.where(F.coalesce(place == end, F.lit(False))).join(tied, F.col("__src").eqNullSafe(F.col("__tied")))
        rank = here.withColumn("__rank", F.expr(f"row_number() OVER (PARTITION BY __src ORDER BY `{text_col}`)")).where("__rank <= __extra OR __whole > 0")
        here = rank.withColumn("__epochs", F.col("__whole") + F.when(F.col("__rank") <= F.col("__extra"), 1).otherwise(0)).select(*names, "__epochs")
        gone = tied.select(F.col("__tied").alias("__gone"))
        out = out.join(gone, F.col("__src").eqNullSafe(F.col("__gone")) & F.coalesce(place == end, F.lit(False)), "left_anti")
        out = out.withColumn("__epochs", F.col("__whole") + more).select(*names, "__epochs").unionByName(here)
    else:
        out = out.withColumn("__epochs", F.col("__whole") + more).select(*names, "__epochs")
    out = out.withColumn("__epochs", F.least(F.lit(cap), F.col("__epochs")).cast("int")).where("__epochs > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__epochs")))).select(*names)


def mix_sql(weights=(5, 2, 1), share=1.5, cap=2, seed="mix") -> str:
    """The same in DuckDB's SQL, from the table ``documents``."""
    return f"""
WITH sized AS (SELECT doc_id AS id, source AS src, md5(concat('{seed}|', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
t AS ({targets_sql("sized", weights, share, cap)}),
p AS (SELECT sized.*, source_size, target,
  sum(size) OVER (PARTITION BY sized.src ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS first
  FROM sized JOIN t ON sized.src IS NOT DISTINCT FROM t.src),
e AS (SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) + CASE WHEN size > 0 AND first + size / 2e0
  <= target - floor(target / source_size) * source_size THEN 1 ELSE 0 END END AS BIGINT) AS epochs FROM p)
SELECT id AS doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(least(epochs, {cap}) * size AS BIGINT) AS taken,
  CAST(least(epochs, {cap}) AS BIGINT) AS epochs FROM e
"""
