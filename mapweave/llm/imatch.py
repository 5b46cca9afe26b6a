"""Document fingerprints by I-Match, in DataFrame functions only.

Terms with an inverse document frequency in a band form the lexicon; a text's
distinct lexicon terms, sorted, are hashed once for each of several randomised
subsets of the lexicon. A small edit changes few of the hashes.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir

#: Words: runs of letters and digits in lower case.
SPLIT = "[^\\\\p{L}\\\\p{N}]+"
#: Subsets of the lexicon: COARSE with a term in COARSE of it each, and FINE with a term in COARSE * FINE / 2, for long texts.
COARSE, FINE = 32, 16


def terms(text: str) -> Column:
    return F.expr(f"array_remove(split(lower({text}), '{SPLIT}'), '')")


def lexicon(docs: DataFrame, low: float = 0.01, high: float = 0.25, least: int = 2) -> DataFrame:
    """The terms that stand in a share of ``low`` to ``high`` of the texts, at least ``least`` of them: one row, an array.

    Its size is bounded: no more than the mean number of distinct terms of a
    text, divided by ``low``. All texts are counted.
    """
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(terms("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    band = df.join(F.broadcast(n), F.expr(f"df >= greatest({least}, {low} * n) AND df <= {high} * n"))  # n: one row
    return band.agg(F.sort_array(F.collect_list("t")).alias("lexicon"))


def fingerprint(df: DataFrame, text: str, lex: Column, out: str) -> DataFrame:
    """``df`` with ``out``, an array of hashes, one for each subset; null where a subset has none of the text's terms.

    A text without lexicon terms uses all its terms instead. Each step is a column
    of its own, so that none is worked out twice.
    """
    mark = lambda ts: F.when(F.size(ts) > 0, F.xxhash64(F.array_join(F.transform(ts, lambda p: p["t"]), " ")))
    df = df.withColumn("__terms", terms(text)).withColumn("__in", F.array_intersect("__terms", lex))
    df = df.withColumn("__used", F.array_sort(F.when(F.size("__in") > 0, F.col("__in")).otherwise(F.array_distinct("__terms"))))
    df = df.withColumn("__pairs", F.transform("__used", lambda t: F.struct(F.xxhash64(t).alias("h"), t.alias("t"))))
    df = df.withColumn("__thin", F.filter("__pairs", lambda p: F.pmod(F.shiftright(p["h"], 40), F.lit(FINE)) == 0))
    coarse = F.transform(F.sequence(F.lit(0), F.lit(COARSE - 1)), lambda i: mark(F.filter("__pairs", lambda p: F.pmod(p["h"], F.lit(COARSE)) == i)))
    fine = F.transform(F.sequence(F.lit(0), F.lit(FINE - 1)), lambda i: mark(F.filter("__thin", lambda p: F.pmod(F.shiftright(p["h"], 20), F.lit(FINE)) == i)))
    return df.withColumn(out, F.concat(coarse, fine)).drop("__terms", "__in", "__used", "__pairs", "__thin")


def likeness(a: Column, b: Column) -> Column:
    """Of the subsets of which either text has a term, the share with equal hashes; two texts without any word are alike."""
    zipped = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.size(F.filter(zipped, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    equal = F.size(F.filter(zipped, lambda p: p["a"] == p["b"]))
    return F.when(either > 0, equal / either).otherwise(1.0).cast("double")


def text_of(fp: Column) -> Column:
    """A fingerprint as a string: hexadecimal hashes, '-' for an empty subset."""
    return F.array_join(F.transform(fp, lambda h: F.coalesce(F.lower(F.hex(h)), F.lit("-"))), ".")


def next_ids(rows: DataFrame) -> tuple[DataFrame, bool]:
    """((id, ih, n_chars, next_id, next_h), whether rows repeat) of rows (doc_id, h, text).

    Next is by descending doc_id, equal ids by a hash of the text; null ids come
    last; after the last stands the first. Ids alone are sorted over ranges;
    within a range the next one is a window's lead, and a row for each range
    joins their ends. Rows equal in id and text count once.
    """
    spark = rows.sparkSession
    light = rows.select("doc_id", "h", F.length("text").alias("n_chars"))
    distinct = light.groupBy("doc_id", "h").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("times"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").desc()]
    path = shared_dir(spark, "order")
    distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    ids = spark.read.schema("doc_id long, h long, n_chars int, times long, part int").parquet(path)
    lead = "lead(struct(doc_id, h)) OVER (PARTITION BY part ORDER BY doc_id DESC NULLS LAST, h DESC)"
    top = F.struct(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "h")
    first = ids.groupBy("part").agg(F.max_by(F.struct("doc_id", "h"), top).alias("head"))
    ends = "coalesce(lead(head) OVER (ORDER BY part), first(head) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    first = first.selectExpr("part AS part2", f"{ends} AS follow")
    pairs = ids.withColumn("nxt", F.expr(lead)).join(F.broadcast(first), F.col("part") == F.col("part2"))  # a row for each range
    pairs = pairs.select("doc_id", "h", "n_chars", F.coalesce("nxt", "follow").alias("nxt"))
    pairs = materialise(pairs.selectExpr("doc_id AS id", "h AS ih", "n_chars", "nxt.doc_id AS next_id", "nxt.h AS next_h"), "next")
    return pairs, not ids.where("times > 1").isEmpty()


def compare_edits(docs: DataFrame, low: float = 0.01, high: float = 0.25) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every whole text.

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many of the next text. Null text: empty. Rows equal in id and text
    have equal results, each its own row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The lexicon's size is bounded (see there), so it goes into the plan as a constant.
    words = lexicon(rows.select("text"), low, high).first()["lexicon"]
    band = F.from_json(F.lit(json.dumps(words, ensure_ascii=False)), "array<string>")
    rows = rows.withColumn("h", F.xxhash64("text"))
    pairs, twice = next_ids(rows)
    same = lambda a, b, x, y: F.col(a).eqNullSafe(F.col(b)) & (F.col(x) == F.col(y))
    heads = rows.join(pairs, same("doc_id", "next_id", "h", "next_h")).select("id", "ih", "next_id", "next_h", F.expr("left(text, n_chars div 2)").alias("head"))
    if twice:
        heads = heads.groupBy("id", "ih", "next_id", "next_h").agg(F.first("head").alias("head"))
    both = rows.join(heads, same("doc_id", "id", "h", "ih")).withColumn("edited", F.expr("concat(left(text, length(text) - length(text) div 2), head)"))
    both = fingerprint(fingerprint(both, "text", band, "fp"), "edited", band, "efp")
    marks = both.select("doc_id", "h", "next_id", "next_h", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", "efp")
    marks = materialise(marks, "fingerprints")
    other = marks.select(F.col("doc_id").alias("id"), F.col("h").alias("ih"), F.col("fp").alias("next_fp"))
    if twice:
        other = other.groupBy("id", "ih").agg(F.first("next_fp").alias("next_fp"))
    out = marks.join(other, same("next_id", "id", "next_h", "ih"))
    return out.select("doc_id", "n_chars", "edited_sha256", text_of(F.col("fp")).alias("fingerprint"), text_of(F.col("efp")).alias("edited_fingerprint"),
                      likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
