"""Mixing sources to target weights by Efraimidis-Spirakis sampling (2). DataFrame functions only.

Each document's key is ``-ln(u) / quality weight`` with ``u`` from the md5 of its id
and text, so reruns agree. Within a source, documents in key order are a weighted
sample without replacement. A source first gives as many complete epochs as its
target holds, then the documents whose midpoint in the running word total lies
within the rest. So it ends within half a document of its target.

No source is ever sorted whole. Words are summed per (source, key bucket), the running
total is taken over those sums, and documents are ordered only inside the one bucket of
each source that the rest ends in. Bucket count follows the row count. Documents
are never shuffled by source: the per-source limits come to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.common import broadcast_if_small, fresh, register, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP = (5, 2, 1), 3
BUCKET_ROWS = 10_000
#: sampling weight of a document by labels.quality: 1, 0, not labelled
QUALITY = (2.0, 0.5, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Weights repeat over the sources by code point, null last. Shares stop at ``cap``
    times a source's size and the excess goes to the others by weight. The windows
    run over one row per source.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("w")).withColumn("full", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = (s.withColumn("nth", F.row_number().over(order))
         .withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
                     / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))))
    first = F.min_by(F.when(F.col("level") <= F.col("full") / F.col("w"), F.col("level")),
                     F.when(F.col("level") <= F.col("full") / F.col("w"), F.col("nth"))).over(every)
    return s.select("source", "source_size", F.least("full", first * F.col("w")).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights=WEIGHTS, cap: int = CAP, keep: list[str] | None = None,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, list[str]]:
    """Rows of ``docs`` (columns ``keep``, all by default) with size, source_size, target, copies and taken.

    Returns the frame and the names of the five new columns. ``quality`` has (id, quality 0/1),
    repeated ids count by their largest. Null texts have size 0, null sources are one source (the
    last). Rows equal in id and text share a key and are taken together. A text without words takes no
    words. Empty table: empty result.
    """
    keep = docs.columns if keep is None else keep
    size, ssize, target, copies, taken, key, tie, bucket, qual = fresh(
        docs.columns, "size", "source_size", "target", "copies", "taken", "es_key", "es_tie", "es_bucket", "es_quality")
    hashed = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text_col, F.lit(""))).cast("binary"))
    rows = docs.withColumn(size, word_count(F.col(text_col))).withColumn(tie, hashed)
    rows = rows.select(*dict.fromkeys([*keep, id_col, source_col]), size, tie)
    weight = F.lit(QUALITY[2])
    if quality is not None:
        best = quality.groupBy(quality.columns[0]).agg(F.max(quality.columns[1]).alias(qual)).toDF("es_id", qual)
        rows = rows.join(best, rows[id_col] == best["es_id"], "left").drop("es_id")
        weight = F.when(F.col(qual) == 1, QUALITY[0]).when(F.col(qual) == 0, QUALITY[1]).otherwise(QUALITY[2])
    u = (F.conv(F.substring(tie, 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)
    rows = written(rows.withColumn(key, -F.log(u) / weight))
    n = rows.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    rows = rows.withColumn(bucket, F.floor((1 - F.exp(-F.col(key))) * buckets).cast("int"))
    sums = written(rows.groupBy(F.col(source_col).alias("source"), F.col(bucket).alias("b")).agg(F.sum(size).alias("words")))
    goal = written(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
                   .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
                   .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    # the bucket of each source in which the rest of its target ends
    run = sums.withColumn("start", F.sum("words").over(Window.partitionBy("source").orderBy("b")) - F.col("words"))
    g = goal.select(F.col("source").alias("gs"), "source_size", "target", "epochs", "rest")
    ends = (run.join(broadcast_if_small(g), F.col("source").eqNullSafe(F.col("gs")))
            .where((F.col("start") < F.col("rest")) & (F.col("start") + F.col("words") > F.col("rest")))
            .select("gs", F.col("b").alias("cut"), "start", F.col("rest").alias("r")))
    inside = (rows.join(broadcast_if_small(ends), F.col(source_col).eqNullSafe(F.col("gs")) & (F.col(bucket) == F.col("cut")))
              .select("gs", "cut", "start", "r", F.col(size).alias("n"), F.struct(F.col(key).alias("e"), F.col(tie).alias("t")).alias("k")))
    before = F.col("start") + F.sum("n").over(Window.partitionBy("gs").orderBy("k")) - F.col("n")
    # equal keys end together in the running sum: the default frame counts peers
    cut = (inside.withColumn("mid", 2 * before + F.col("n")).groupBy("gs", "cut")
           .agg(F.max(F.when(F.col("mid") <= 2 * F.col("r"), F.col("k"))).alias("last")))
    ended = g.join(cut.withColumnRenamed("gs", "cs"), F.col("gs").eqNullSafe(F.col("cs")), "left")
    # without such a bucket the rest ends on a bucket's border: whole buckets before it
    border = run.join(broadcast_if_small(g), F.col("source").eqNullSafe(F.col("gs"))).where(
        F.col("start") + F.col("words") <= F.col("rest")).groupBy("gs").agg((F.max("b") + 1).alias("whole"))
    limits = ended.join(border.withColumnRenamed("gs", "ws"), F.col("gs").eqNullSafe(F.col("ws")), "left").select(
        F.col("gs").alias("es_source"), F.col("source_size").alias("ls"), F.col("target").alias("lt"), "epochs",
        F.coalesce("cut", "whole", F.lit(0)).alias("cut"), "last")
    limits = broadcast_if_small(written(limits))
    more = (F.col(bucket) < F.col("cut")) | F.coalesce(
        (F.col(bucket) == F.col("cut")) & (F.struct(F.col(key).alias("e"), F.col(tie).alias("t")) <= F.col("last")), F.lit(False))
    out = rows.join(limits, F.col(source_col).eqNullSafe(F.col("es_source")))
    n_copies = F.col("epochs") + more.cast("long")
    out = out.select(*keep, size, F.col("ls").alias(ssize), F.col("lt").alias(target), n_copies.alias(copies),
                     (n_copies * F.col(size)).alias(taken))
    return out, [size, ssize, target, copies, taken]


ORACLE_SQL = f"""
WITH lab AS (SELECT doc_id AS lid, max(quality) AS q FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h,
        CASE WHEN q = 1 THEN 2.0 WHEN q = 0 THEN 0.5 ELSE 1.0 END AS qw
      FROM documents LEFT JOIN lab ON doc_id = lid),
k AS (SELECT *, -ln((CAST(CAST('0x' || substr(h, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / qw AS e FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn
      FROM k GROUP BY source),
w AS (SELECT *, CAST(CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
        source_size * 3.0 AS capped FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY capped / w, rn) AS nth FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM o) - coalesce(sum(capped) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / ((SELECT sum(w) FROM o) - coalesce(sum(w) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
g AS (SELECT source, source_size, least(capped, w * (SELECT arg_min(level, nth) FROM l WHERE level <= capped / w)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        sum(k.size) OVER (PARTITION BY k.source ORDER BY k.e, k.h) - k.size AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * (epochs + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""


@register("op2_mixing", ORACLE_SQL)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    out, (size, ssize, target, _, taken) = mix(docs, quality, keep=["doc_id"])
    return out.select("doc_id", size, ssize, target, taken)
