"""Matching called URLs with endpoints: a pattern join, held small by HTTP method, number of segments and the segments that a template names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Signs that a pattern reads as more than themselves, once ``*`` and ``{v}`` are gone.
SPECIAL = r"[\\^$|?+()\[\]{}\u0001]"


def _key(path: Column, places: Column) -> Column:
    """The segments of ``path`` at ``places``. Line ends at its end do not count, as ``$`` stands before one, too."""
    parts = F.split(F.regexp_replace(path, r"[\n\r\u0085\u2028\u2029]+\z", ""), "/")
    return F.array_join(F.transform(places, lambda k: F.get(parts, k)), "/")


def _places(template: Column) -> Column:
    """Places of the segments that any URL of ``template`` has word for word; none if it holds other signs of a pattern."""
    plain = ~F.regexp_replace(template, r"\*|[{][^}/]*[}]", "").rlike(SPECIAL)
    fixed = F.transform(F.split(template, "/"), lambda x, k: F.when(~x.rlike("[*{]"), k))
    return F.when(plain, F.filter(fixed, lambda k: k.isNotNull())).otherwise(F.array().cast("array<int>"))


def compared(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """``call_id, url, path, endpoint_id, template, pattern``: the pairs that ``candidates`` looks at.

    ``calls``: call_id, url, method. ``endpoints``: endpoint_id, template,
    methods (array; null or empty: any). Templates without ``**`` join on their
    number of segments and on those that they name: which these are is a shape,
    of which templates have few, and a call has a key for each shape of its
    length. The few with ``**`` are joined by method alone.
    """
    c = calls.select("call_id", text.normalize_url(F.col("url")).alias("path"), "url", F.upper("method").alias("method"))
    c = c.withColumn("n", text.segments(F.col("path")))
    e = endpoints.withColumn("wide", F.col("template").contains("**")).withColumn("pattern", text.url_pattern(F.col("template")))
    any_method = F.coalesce(F.size("methods"), F.lit(0)) <= 0
    e = e.withColumn("m", F.explode(F.when(any_method, F.array(F.lit("*"))).otherwise(F.transform("methods", lambda x: F.upper(x)))))
    c = c.withColumn("m", F.explode(F.array_distinct(F.array(F.lit("*"), F.coalesce("method", F.lit("*"))))))
    short = e.where(~F.col("wide")).withColumn("n", text.segments(F.col("template"))).withColumn("places", _places(F.col("template"))).withColumn("key", _key(F.col("template"), F.col("places")))
    keyed = c.join(short.select("m", "n", "places").distinct(), ["m", "n"]).withColumn("key", _key(F.col("path"), F.col("places")))
    narrow = keyed.join(short, ["m", "n", "places", "key"])
    wide = c.join(e.where("wide"), "m")
    cols = ["call_id", "url", "path", "endpoint_id", "template", "pattern"]
    return narrow.select(*cols).unionByName(wide.select(*cols))


def candidates(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """``call_id, url, endpoint_id, template, exact``: the pairs of ``compared`` that match."""
    hit = compared(calls, endpoints).where((F.col("path") == F.col("template")) | F.expr("path rlike pattern"))
    return hit.select("call_id", "url", "endpoint_id", "template", (F.col("path") == F.col("template")).alias("exact")).distinct()


def match(calls: DataFrame, endpoints: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """``call_id, url, endpoint_id, confidence, method`` for every call.

    One candidate: 0.9 by pattern. None: no match. More: what ``verified``
    (call_id, match, confidence and, optionally, failed) says, the best
    candidate (exact first, then by endpoint_id) with its confidence or no
    match; the best with 0.5 as ``fallback`` where the verifier failed; without
    ``verified`` no match.
    """
    found = candidates(calls, endpoints)
    per = found.groupBy("call_id").agg(F.count("*").alias("k"), F.min(F.struct((~F.col("exact")).alias("loose"), "endpoint_id")).alias("best"))
    out = calls.select("call_id", "url").join(per, "call_id", "left")
    if verified is None:
        out = out.withColumn("ok", F.lit(False)).withColumn("vconf", F.lit(0.0)).withColumn("failed", F.lit(False))
    else:
        failed = F.col("failed") if "failed" in verified.columns else F.lit(False)
        said = verified.select("call_id", F.col("match").alias("ok"), F.coalesce("confidence", F.lit(0.7)).alias("vconf"), failed.alias("failed"))
        out = out.join(said, "call_id", "left").fillna(False, ["ok", "failed"])
    one, many = F.col("k") == 1, F.col("k") > 1
    fallback = many & F.col("failed")
    return out.select(
        "call_id", "url",
        F.when(one | fallback | (many & F.col("ok")), F.col("best.endpoint_id")).alias("endpoint_id"),
        F.when(one, F.lit(0.9)).when(fallback, F.lit(0.5)).when(many & F.col("ok"), F.col("vconf")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(one, "pattern_match").when(fallback, "fallback").when(many, "llm").otherwise("no_match").alias("method"),
    )


def candidates_text(found: DataFrame, endpoints: DataFrame) -> DataFrame:
    """``call_id, text``: the candidates of each call as numbered lines for a reviewer, exact ones first."""
    e = endpoints.select("endpoint_id", F.array_join(F.coalesce("methods", F.array().cast("array<string>")), ", ").alias("methods"))
    rows = found.join(e, "endpoint_id").select("call_id", F.struct((~F.col("exact")).alias("loose"), F.col("endpoint_id").cast("string").alias("endpoint"), "template", "methods").alias("c"))
    listed = rows.groupBy("call_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    line = lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["endpoint"], F.lit(" at "), c["template"], F.when(c["methods"] != "", F.concat(F.lit(" for "), c["methods"])).otherwise(F.lit("")))
    return listed.select("call_id", F.array_join(F.transform("cs", line), "\n").alias("text"))
