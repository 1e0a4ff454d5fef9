"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word budget: a share of the wanted total by its weight, but at most
`max_epochs` times its size, the excess going to the others by weight. With the cap c = max_epochs
* size, budgets are min(c, level * weight) for the one level at which they sum to the total; it is
found from prefix sums over the sources in order of c / weight. A budget is spent on complete
epochs first. The rest goes to a weighted sample without replacement: each document draws an
exponential key, -ln(u) / weight, from a hash of its id and text, and the source's documents are taken
in order of their keys up to the budget, the last one only if that comes closer to it.

Budgets are found by windows over one row for each source, in one task: sources are names of crawls
or sites' groups, thousands at most, not documents. Prefix sums over a source are found in two levels, so that no task gets a whole source: keys fall
into buckets of a few thousand documents, bucket totals are summed up first, and then the rows
inside each bucket.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own,
after all others; repeated rows draw equal keys and count as documents of their own; a source of
size 0 has target 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagraph.llm.runtime import cut, small_side

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE, MAX_EPOCHS = 1.5, 2
#: Documents in a bucket, on average.
BUCKET_ROWS = 2_000
#: Quality weights are letters per character that isn't white space, at least this.
LEAST_QUALITY = 0.05
WORD = r"[^\x20\x09-\x0D]+"


def uniform(id_col: Column, text: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of the MD5 of seed, id and the text's MD5: rows with one id, or none, are spread too."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def quality(text: Column) -> Column:
    """Letters per character that isn't white space: junk of symbols and digits gets low keys rarely."""
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return F.coalesce(F.greatest(letters / F.greatest(solid, F.lit(1)), F.lit(LEAST_QUALITY)), F.lit(LEAST_QUALITY))


def budgets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, n_docs and source_size with the target of each; the table has a row for each source only."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    t = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(max_epochs))
    t = t.withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    t = t.withColumns({
        "capped": F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)),
        "left": F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(everything) * float(total_share),
    })
    # the level if this source and all later ones aren't capped; the first at which that fits is the level
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.col("capped"), F.lit(0.0))) / F.col("left"))
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "source", "level"))).over(everything)["level"]
    return t.withColumn("found", level).select("source", "n_docs", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap"), F.coalesce("found", F.col("fill")) * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS, seed: str = "mix", quality_col: str | None = None, bucket_rows: int = BUCKET_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words of the document in the mix) for each row, and the columns `carry`."""
    t = F.col(text).cast("string")
    q = F.greatest(F.col(quality_col).cast("double"), F.lit(1e-9)) if quality_col else quality(t)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(t, F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"), q.alias("q"), uniform(F.col(id_col), t, seed).alias("u"), *carry)
    slim = cut(slim.withColumn("key", -F.log("u") / F.col("q")).drop("u"))
    totals = slim.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"), F.avg("q").alias("__q"))
    totals = cut(totals)
    plan = budgets(totals.select("source", "n_docs", "source_size"), weights, total_share, max_epochs)
    plan = plan.withColumnRenamed("source", "__s").join(totals.select(F.col("source").alias("__t"), "__q"), F.col("__s").eqNullSafe(F.col("__t"))).drop("__t")
    size = F.col("source_size")
    plan = plan.withColumn("epochs", F.when(size == 0, F.lit(0)).otherwise(F.floor(F.col("target") / size)).cast("long"))
    plan = plan.withColumn("budget", F.col("target") - F.col("epochs") * size).withColumn("buckets", F.greatest(F.ceil(F.col("n_docs") / bucket_rows), F.lit(1)))
    plan = small_side(cut(plan))
    rows = slim.join(plan, F.col("source").eqNullSafe(F.col("__s")), "left")
    # increasing in the key; even if all weights are alike
    rows = rows.withColumn("bucket", F.floor((1 - F.exp(-F.col("key") * F.col("__q"))) * F.col("buckets")).cast("long"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = small_side(cut(sums.select(F.col("source").alias("__s2"), F.col("bucket").alias("__b"), F.coalesce(before, F.lit(0)).alias("before_bucket"))))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("__s2")) & (F.col("bucket") == F.col("__b")), "left")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before_bucket") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rows = rows.withColumn("start", start)
    picked = (F.col("start") < F.col("budget")) & (2 * (F.col("budget") - F.col("start")) >= F.col("size"))
    taken = F.col("size") * (F.col("epochs") + F.when(picked, 1).otherwise(0))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)


#: DuckDB's equivalent of the query over `documents`.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    coalesce(greatest(length(regexp_replace(text, '\P{L}+', '', 'g'))::DOUBLE / greatest(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')), 1)::DOUBLE, 0.05::DOUBLE), 0.05::DOUBLE) AS q,
    (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / q AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM d GROUP BY source),
f AS (SELECT *, source_size::DOUBLE * 2 AS cap, source_size::DOUBLE * 2 / w AS fill, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
v AS (SELECT level AS found FROM l WHERE level <= fill ORDER BY fill, source NULLS LAST LIMIT 1),
p AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(cap, (SELECT found FROM v) * w) END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM p),
r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN start < budget AND 2 * (budget - start) >= size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
