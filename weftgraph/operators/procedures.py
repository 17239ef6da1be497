"""Who calls a stored procedure: triggers, scheduler jobs and mapper statements; and what to ask about it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as t
from . import verify


def trigger_callers(procedures: DataFrame, triggers: DataFrame) -> DataFrame:
    """``procedure, trigger_name``: triggers (trigger_name, description) whose text holds the name.

    Descriptions are cut into words first, so this is a join on words and not
    of every pair.
    """
    words = triggers.select("trigger_name", F.explode(F.array_distinct(F.split(F.upper("description"), r"[^A-Z0-9_$]+"))).alias("word"))
    p = procedures.select(F.col("name").alias("procedure"), F.upper("name").alias("word"))
    return p.join(words, "word").select("procedure", "trigger_name").distinct()


def job_callers(procedures: DataFrame, jobs: DataFrame) -> DataFrame:
    """``procedure, job_name, enabled``: jobs (job_name, job_type, job_action, enabled, broken) that call it, in any case, packaged or not."""
    j = jobs.select("job_name", F.coalesce("enabled", ~F.col("broken")).alias("enabled"), F.upper(t.job_procedure(F.col("job_type"), F.col("job_action"))).alias("called"))
    j = j.withColumn("word", F.element_at(F.split("called", "[.]"), -1))
    p = procedures.select(F.col("name").alias("procedure"), F.upper("name").alias("word"))
    return p.join(j, "word").select("procedure", "job_name", "enabled")


def statement_callers(procedures: DataFrame, statements: DataFrame) -> DataFrame:
    """``procedure, namespace, statement_id``: callable statements that call it."""
    s = statements.where("is_callable").select("namespace", F.col("id").alias("statement_id"), F.upper("procedure_name").alias("word"))
    p = procedures.select(F.col("name").alias("procedure"), F.upper("name").alias("word"))
    return p.join(s, "word").select("procedure", "namespace", "statement_id")


def procedure_context(procedures: DataFrame, triggers: DataFrame, jobs: DataFrame, statements: DataFrame) -> DataFrame:
    """``procedure, source, triggers, jobs, statements``: what a reviewer of the procedure is shown; its source up to 10,000 characters."""
    side = lambda df, name, col: df.groupBy("procedure").agg(F.sort_array(F.collect_set(col)).alias(name))
    out = procedures.select(F.col("name").alias("procedure"), F.substring(F.coalesce("source_code", F.lit("")), 1, config.SOURCE_CHARS).alias("source"))
    for df, name, col in ((trigger_callers(procedures, triggers), "triggers", F.col("trigger_name")), (job_callers(procedures, jobs), "jobs", F.col("job_name")), (statement_callers(procedures, statements), "statements", F.concat_ws(".", "namespace", "statement_id"))):
        out = out.join(side(df, name, col), "procedure", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


#: Parts of a review and the fields of each, as a reviewer answers them.
REVIEW = """business_analysis struct<business_purpose: string, business_scenario: string, estimated_frequency: string, data_volume: string>,
operation_analysis struct<operation_type: string, operation_details: string>,
impact_analysis struct<affected_tables: array<struct<table_name: string, operations: array<string>, estimated_rows: string>>>,
trigger_analysis struct<trigger_method: string, trigger_details: map<string, string>, confidence: string, reasoning: string>,
quality_assessment struct<exception_handling: struct<has_exception_block: boolean, handles_errors_properly: boolean, logs_errors: boolean, risk_level: string, issues: array<string>>, transaction_management: struct<has_explicit_commit: boolean, has_rollback: boolean, is_autonomous: boolean, transaction_scope: string, risk_level: string, issues: array<string>>>,
conflict_analysis struct<conflicts: array<struct<batch_job: string, conflict_type: string, severity: string, description: string, affected_tables: array<string>>>, debug_difficulty: struct<level: string, has_logging: boolean, error_messages_clear: boolean, reproducible: string, issues: array<string>>>,
integration_recommendation struct<recommendation: string, integration_options: array<struct<option: string, description: string, difficulty: string, estimated_effort: string, pros: array<string>, cons: array<string>, prerequisites: array<string>>>, preferred_option: struct<option: string, reasoning: string, implementation_steps: array<string>>>,
risk_assessment struct<risks: array<struct<category: string, severity: string, description: string, impact: string, mitigation: string>>, overall_risk_level: string, optimizations: array<struct<priority: string, category: string, suggestion: string, expected_benefit: string>>>"""
PARTS = tuple(line.split(" ", 1)[0] for line in REVIEW.splitlines())


def find_procedure(procedures: DataFrame, name: str) -> DataFrame:
    """The first procedure, by full name, whose name or full name is ``name``, in any case."""
    full = F.col("full_name") if "full_name" in procedures.columns else F.col("name")
    hit = (F.upper("name") == name.upper()) | (F.upper(full) == name.upper())
    return procedures.where(hit).orderBy(full, "name").limit(1)


def review_prompt() -> Column:
    """The question about one row of ``procedure_context``: what is known of the procedure and which parts the answer has."""
    known = [F.concat(F.lit(f"{k}: "), F.coalesce(F.nullif(F.array_join(k, ", "), F.lit("")), F.lit("none known"))) for k in ("triggers", "jobs", "statements")]
    ask = f"Review this stored procedure. Answer with one JSON object in a fenced block, with the parts {', '.join(PARTS)} and fields as in: {REVIEW}"
    return F.concat_ws("\n", F.lit(ask), F.concat(F.lit("Procedure: "), "procedure"), *known, F.lit("Source:"), "source")


def analyse(context: DataFrame, ask: Callable[[str], str] | None = None) -> DataFrame:
    """``procedure``, the parts of its review, ``analysed_at`` and ``error`` for each row of ``procedure_context``; without ``ask``, or where an answer is no JSON, the error says so."""
    if ask is None:
        parts = F.from_json(F.lit(None).cast("string"), REVIEW)
        return context.select("procedure", *[parts[p].alias(p) for p in PARTS], F.current_timestamp().alias("analysed_at"), F.lit("no model is available").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"procedure": p["procedure"], "answer": [ask(x) for x in p["prompt"]]})

    answered = context.select("procedure", review_prompt().alias("prompt")).mapInPandas(run, "procedure string, answer string")
    got = answered.withColumn("r", F.from_json(verify.json_of_answer(F.col("answer")), REVIEW))
    none = F.greatest(*[F.col(f"r.{p}").isNotNull() for p in PARTS])
    return got.select("procedure", *[F.col(f"r.{p}").alias(p) for p in PARTS], F.current_timestamp().alias("analysed_at"), F.when(~F.coalesce(none, F.lit(False)), "the answer has no part of a review").alias("error"))
