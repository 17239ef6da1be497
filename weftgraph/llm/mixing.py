"""Mixing sources to target weights.

Tokens (words) are summed per source, targets follow the weights with a cap on
repetition, and each document is emitted ``floor(rate)`` times plus one copy
drawn by a hash-seeded Bernoulli trial with the fraction as its probability.
All of it is DataFrame code: one pre-aggregated shuffle on the source, one
window over the sources alone, and a join with the sources' rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, small_side, table

WEIGHTS = (1, 2, 3)
MAX_RATE = 3.0
SEED = "mix-1"


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """``source, source_size, target, rate`` from rows of ``source, size``.

    Sources in code-point order (null last) weigh ``weights``, repeating. Shares
    of the total stop at ``max_rate`` times a source's size; what is over goes
    to the others by weight. That fixed point is a water level: with sources by
    rising ``cap / weight``, the level is the largest of
    ``(total - caps before) / weights from here on``.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(max_rate)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level)
    target = F.least(F.col("cap"), F.max("level").over(everything) * F.col("weight"))
    per = per.withColumn("target", target.cast("double"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_rate)))).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "target", rate.alias("rate"))


def hash_unit(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on ``key`` and ``seed`` alone."""
    h = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("~")), F.lit(":" + seed)).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: float = MAX_RATE, seed: str = SEED) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies``.

    A null or empty text has size 0; a null source is a source of its own; rows
    that repeat a ``doc_id`` share its draw. An empty table gives no rows. Input
    columns named like the added ones are replaced.
    """
    sized = docs.drop("size", "source_size", "target", "rate", "copies").withColumn("size", word_count())
    rates = materialize(source_rates(sized.select("source", "size"), weights, max_rate), "mix-rates")
    n = rates.count()
    r = rates.withColumnRenamed("source", "_source")
    out = sized.join(small_side(r, n), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    whole = F.floor("rate")
    extra = (hash_unit(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return out.withColumn("copies", (whole + extra).cast("long")).drop("rate")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as its copies say, columns and their values as given."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")
    out = copies(docs.select("doc_id", "text", "source", whole), **options).where("copies > 0")
    return out.select("_whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_whole.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 3.0::DOUBLE AS cap,
        ([1, 2, 3])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM p),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight)::DOUBLE AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM t),
c AS (SELECT d.doc_id, d.size, r.source_size, r.target,
        (floor(r.rate) + CASE WHEN ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '~') || ':mix-1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0
                              < r.rate - floor(r.rate) THEN 1 ELSE 0 END)::BIGINT AS copies
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
