"""Verification by an injected model, its cache and its limits.

No model is called from here: ``verify`` takes a function from prompt to
answer. Without one, every row says that none is available.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import semantic_hash

ANSWER = "match boolean, confidence double, reasoning string"


#: A worked example of each relation that is often asked: what stands there, and the answer.
EXAMPLES = {
    "CALLS": ("$.post('/item/' + id) against @PostMapping(\"/item/{key}\")", '{"match": true, "confidence": 0.9, "reasoning": "same method, the variable part fits the template"}'),
    "INVOKES": ("stock.take(n) against class Stock { void give(int n) }", '{"match": false, "confidence": 0.9, "reasoning": "no method of that name"}'),
    "USES": ("itemMapper.byKey(k) against interface ItemMapper { Item byKey(String k); }", '{"match": true, "confidence": 1.0, "reasoning": "declared in the interface"}'),
}


def prompt(source: Column, target: Column, relation: Column, source_code: Column, target_code: Column) -> Column:
    """The question about one relation, with an example of its kind and the first 15 lines of each side."""
    head = lambda c: F.array_join(F.slice(F.split(F.coalesce(c, F.lit("")), "\n"), 1, config.CONTEXT_LINES), "\n")
    example = F.lit("No example.")
    for kind, (shown, said) in EXAMPLES.items():
        example = F.when(relation == kind, F.lit(f"Example: {shown}\n<conclusion>{said}</conclusion>")).otherwise(example)
    ends = 'Answer in <conclusion>{"match": .., "confidence": .., "reasoning": ".."}</conclusion>; confidence from 0.9 where it is certain, under 0.5 where it is unlikely.'
    return F.concat_ws("\n", F.concat(F.lit("Does "), source, F.lit(" have relation "), relation, F.lit(" to "), target, F.lit("?")), example, F.lit("Source:"), head(source_code), F.lit("Target:"), head(target_code), F.lit(ends))


def parse_answer(answer: Column) -> Column:
    """Struct of match, confidence, reasoning: JSON in <conclusion>, else the first object that has "match", else no match."""
    tagged = F.nullif(F.regexp_extract(answer, r"(?s)<conclusion>\s*(.*?)\s*</conclusion>", 1), F.lit(""))
    loose = F.nullif(F.regexp_extract(answer, r'(?s)([{][^{}]*"match"[^{}]*[}])', 1), F.lit(""))
    got = F.from_json(F.coalesce(tagged, loose, F.lit("{}")), ANSWER)
    return F.struct(F.coalesce(got["match"], F.lit(False)).alias("match"), F.coalesce(got["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(got["reasoning"], F.lit("unparsable answer")).alias("reasoning"))


def json_of_answer(answer: Column) -> Column:
    """The last fenced JSON block of an answer, else the answer itself."""
    blocks = F.regexp_extract_all(answer, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))
    return F.when(F.size(blocks) > 0, F.trim(F.try_element_at(blocks, F.lit(-1)))).otherwise(F.trim(answer))


def cache_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", semantic_hash(F.concat_ws("\n", "source_code", "target_code"), F.col("relation")))


def verify(rows: DataFrame, ask: Callable[[str], str] | None = None, cache: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``rows`` with match, confidence, reasoning and method (cache, llm, rate_limited or error).

    ``rows`` has source, target, relation, source_code, target_code; ``cache``
    key, match, confidence, reasoning. Only rows that the cache lacks are asked;
    of these the ``limit`` first by key (all if None), the others are
    ``rate_limited``. A question that raises is an error of its row.
    """
    keyed = cache_key(rows)
    if cache is not None:
        known = cache.dropDuplicates(["key"]).select("key", "match", "confidence", "reasoning")
        hits = keyed.join(known, "key").withColumn("method", F.lit("cache"))
        keyed = keyed.join(known, "key", "left_anti")

    def unasked(df: DataFrame, reason: str, method: str) -> DataFrame:
        return df.withColumns({"match": F.lit(False), "confidence": F.lit(0.0), "reasoning": F.lit(reason), "method": F.lit(method)})

    if ask is None:
        asked = unasked(keyed, "no model is available", "error")
    else:
        over = None
        if limit is not None:
            first = keyed.select("key").distinct().orderBy("key").limit(limit)
            over = unasked(keyed.join(first, "key", "left_anti"), "the rate limit is reached", "rate_limited")
            keyed = keyed.join(first, "key", "left_semi")
        with_prompt = keyed.withColumn("_prompt", prompt(F.col("source"), F.col("target"), F.col("relation"), F.col("source_code"), F.col("target_code")))

        def answer(text: str) -> tuple[str | None, str | None]:
            try:
                return ask(text), None
            except Exception as e:  # noqa: BLE001  reported in the row
                return None, f"{type(e).__name__}: {e}"

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                said = [answer(x) for x in p["_prompt"]]
                yield p.assign(_answer=[a for a, _ in said], _error=[e for _, e in said]).drop(columns="_prompt")

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields) + ", _answer string, _error string"
        got = with_prompt.mapInPandas(run, schema).withColumn("_a", parse_answer(F.coalesce("_answer", F.lit(""))))
        failed = F.col("_error").isNotNull()
        asked = got.select(*keyed.columns, "_a.match", "_a.confidence", F.when(failed, F.col("_error")).otherwise(F.col("_a.reasoning")).alias("reasoning"), F.when(failed, "error").otherwise("llm").alias("method"))
        if over is not None:
            asked = asked.unionByName(over)
    return asked if cache is None else asked.unionByName(hits)


def cache_of(answers: DataFrame, ttl_days: int = config.RESULT_TTL_DAYS) -> DataFrame:
    """Rows for the cache from ``verify``'s results: what a model said, once a key, with the time and the type."""
    said = answers.where("method = 'llm'").select("key", "match", "confidence", "reasoning", F.col("relation").alias("type"))
    return said.dropDuplicates(["key"]).withColumn("cached_at", F.current_timestamp())


def cache_put(cache: DataFrame | None, rows: DataFrame) -> DataFrame:
    """The cache with ``rows``, which replace entries of the same key."""
    return rows if cache is None else cache.join(rows.select("key"), "key", "left_anti").unionByName(rows, allowMissingColumns=True)


def cache_get(cache: DataFrame, keys: DataFrame, now: Column | None = None, days: int = config.RESULT_TTL_DAYS) -> DataFrame:
    """``key, hit, match, confidence, reasoning`` for each row of ``keys`` (key); entries over ``days`` old do not count."""
    live = cache if "cached_at" not in cache.columns else fresh(cache, now if now is not None else F.current_timestamp(), days)
    live = live.dropDuplicates(["key"]).select("key", "match", "confidence", "reasoning", F.lit(True).alias("hit"))
    return keys.join(live, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_stats(events: DataFrame) -> DataFrame:
    """One row from lookups (hit boolean, tokens): hits, misses, hit_rate (3 places), tokens and cost saved by hits (4 places)."""
    out = events.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("tokens"))), F.lit(0)).alias("tokens_saved"))
    total = F.col("hits") + F.col("misses")
    rate = F.when(total > 0, F.round(F.col("hits") / total, 3)).otherwise(F.lit(0.0))
    return out.select("hits", "misses", rate.alias("hit_rate"), "tokens_saved", F.round(F.col("tokens_saved") / 1000 * config.COST_PER_1K, 4).alias("cost_saved"))


def fresh(rows: DataFrame, now: Column, days: int = config.RESULT_TTL_DAYS, at: str = "cached_at") -> DataFrame:
    """Rows no older than ``days``; those without a readable time stay."""
    return rows.where(F.col(at).isNull() | (F.col(at) >= now - F.make_dt_interval(F.lit(days))))


def fingerprint(path: Column, mtime: Column, length: Column) -> Column:
    return F.md5(F.concat_ws(":", path, mtime.cast("string"), length.cast("string")).cast("binary"))


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files (path, fingerprint) that are new or differ from ``before``."""
    return now.join(before.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


def rate_window(events: DataFrame, key: str = "user_id", ts: str = "ts", limit: int = config.RATE_LIMIT, seconds: int = config.RATE_WINDOW_S) -> DataFrame:
    """``events`` with ``in_window`` (events of the key in the trailing window, this one included) and ``allowed``.

    An upper bound on use: rejected events count too. ``streaming.limiter``
    keeps state and counts accepted events only.
    """
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    out = events.withColumn("in_window", F.count("*").over(w))
    return out.withColumn("allowed", F.col("in_window") <= limit)


def batch_summary(results: DataFrame) -> DataFrame:
    """``kind, total, completed, success_rate`` of task results (kind, success)."""
    out = results.groupBy("kind").agg(F.count("*").alias("total"), F.count_if("success").alias("completed"))
    return out.withColumn("success_rate", F.round(F.col("completed") / F.col("total") * 100, 2))


def cache_clear(cache: DataFrame, kind: str | None = None) -> DataFrame:
    """The cache without the entries of a type, or without any."""
    return cache.limit(0) if kind is None else cache.where(F.col("type") != kind)
