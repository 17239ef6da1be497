"""Batch analysis: every file of a project through its extractor, failures kept as rows, with totals and issues."""

from __future__ import annotations

import contextlib
import json
import signal
import threading
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.text import HTTP_BY_ANNOTATION
from ..sources import project
from . import java, mapper, markup, verify

RESULT = "kind string, identifier string, success boolean, result string, error string, seconds double"


def _analyse(kind: str, path: str, content: str) -> dict:
    if kind == "jsp":
        return markup._parse(path, content)
    if kind == "mapper_xml":
        out = mapper.parse_mapper(content)
        if out["error"]:
            raise ValueError(out["error"])
        return out
    return java.parse(content)


@contextlib.contextmanager
def time_limit(seconds: float) -> Iterator[None]:
    """Raise TimeoutError in the block after ``seconds``; without effect off the main thread, where signals do not arrive."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_: object) -> None:
        raise TimeoutError(f"over {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def planned(tasks: DataFrame, batch_size: int = config.BATCH_SIZE) -> DataFrame:
    """Tasks (kind, identifier, priority) from high priority to low over the partitions and within them, with ``batch`` (of ``batch_size`` tasks of a partition) and ``timeout_s`` of their kind."""
    limit = F.lit(config.DEFAULT_TIMEOUT_S)
    for kind, s in config.TIMEOUTS_S.items():
        limit = F.when(F.col("kind").startswith(kind), s).otherwise(limit)
    order = (F.desc("priority"), F.asc("identifier"))
    ordered = tasks.repartitionByRange(*order).sortWithinPartitions(*order)
    nth = F.monotonically_increasing_id()  # partition << 33 | place
    return ordered.withColumn("_n", nth).select(*tasks.columns, (F.shiftright("_n", 33) * 1_000_000 + F.floor(F.col("_n").bitwiseAND(0x1FFFFFFFF) / batch_size)).alias("batch"), limit.alias("timeout_s"))


def progress(done: int, total: int, elapsed_s: float) -> dict[str, float]:
    """Share of tasks that are done, in percent, and the seconds that the others will take at the mean time of one."""
    return {"completed": done, "total": total, "percentage": round(100 * done / total, 1) if total else 0.0, "elapsed_s": round(elapsed_s, 1), "remaining_s": round(elapsed_s / done * (total - done), 1) if done else 0.0}


def job_progress(spark: SparkSession, group: str, elapsed_s: float) -> dict[str, float]:
    """``progress`` over the tasks of a job group that runs in another thread (``spark.sparkContext.setJobGroup``)."""
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else ())]
    known = [s for s in stages if s]
    return progress(sum(s.numCompletedTasks for s in known), sum(s.numTasks for s in known), elapsed_s)


def analyse_files(files: DataFrame, kinds: list[str] | None = None, timeouts: dict[str, float] | None = None) -> DataFrame:
    """One row a file (rel, content): its kind, whether the analysis succeeded, the record as JSON, the error and the time it took.

    Entities have no extractor. An error in one file, or one that takes longer
    than its kind may (``config.TIMEOUTS_S``), is that file's row, not the job's.
    Each partition takes its files from high priority to low if they have one.
    """
    limits = {**config.TIMEOUTS_S, **(timeouts or {})}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for kind, rel, content in zip(p["kind"], p["rel"], p["content"], strict=True):
                began = time.perf_counter()
                try:
                    with time_limit(limits.get(kind.removesuffix("_xml"), config.DEFAULT_TIMEOUT_S)):
                        record = json.dumps(_analyse(kind, rel, content or ""))
                    rows.append((kind, rel, True, record, None, time.perf_counter() - began))
                except Exception as e:  # noqa: BLE001  reported in the row
                    rows.append((kind, rel, False, None, f"{type(e).__name__}: {e}", time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["kind", "identifier", "success", "result", "error", "seconds"])

    todo = project.classify(files, kinds).where("kind <> 'entity'")
    if "priority" in files.columns:
        todo = todo.sortWithinPartitions(F.desc("priority"), "rel")
    return todo.select("kind", "rel", "content").mapInPandas(run, RESULT)


def _items(result: Column) -> Column:
    """What a record counts by kind: endpoints of controllers, methods of services and interfaces, statements of mapper files."""
    methods = F.from_json(F.get_json_object(result, "$.methods"), "array<struct<annotations: array<struct<name: string>>>>")
    mapped = F.size(F.filter(methods, lambda m: F.exists(m["annotations"], lambda a: a["name"].isin(list(HTTP_BY_ANNOTATION)))))
    stated = F.size(F.from_json(F.get_json_object(result, "$.statements"), "array<struct<id: string>>"))
    return F.coalesce(F.when(F.col("kind") == "controller", mapped).when(F.col("kind").isin("service", "mapper"), F.size(methods)).when(F.col("kind") == "mapper_xml", stated), F.lit(0))


def issues_of(results: DataFrame) -> DataFrame:
    """``issue, severity, node_id, message``: failed files (high) and interfaces with methods that no mapper file states (medium)."""
    failed = results.where("not success").select(F.lit("analysis_failed").alias("issue"), F.lit("high").alias("severity"), F.col("identifier").alias("node_id"), F.col("error").alias("message"))
    method = F.from_json(F.get_json_object("result", "$.methods"), "array<struct<name: string>>")
    space = F.concat_ws(".", F.nullif(F.get_json_object("result", "$.package"), F.lit("")), F.get_json_object("result", "$.class_name"))
    declared = results.where("success and kind = 'mapper'").select("identifier", space.alias("namespace"), F.explode(method["name"]).alias("method"))
    stated = results.where("success and kind = 'mapper_xml'").select(F.get_json_object("result", "$.namespace").alias("namespace"), F.explode(F.from_json(F.get_json_object("result", "$.statements"), "array<struct<id: string>>")["id"]).alias("method"))
    lost = declared.distinct().join(stated.distinct(), ["namespace", "method"], "left_anti").groupBy("identifier").agg(F.count("*").alias("n"))
    lost = lost.select(F.lit("unmapped_methods").alias("issue"), F.lit("medium").alias("severity"), F.col("identifier").alias("node_id"), F.concat(F.col("n").cast("string"), F.lit(" without a statement")).alias("message"))
    return failed.unionByName(lost)


def report(results: DataFrame) -> dict[str, DataFrame]:
    """``by_kind`` (totals, success rate), ``items`` (what the records hold), ``overall``, ``issues`` and their count by ``severity``."""
    by_kind = verify.batch_summary(results)
    items = results.groupBy("kind").agg(F.sum(F.when(F.col("success"), _items(F.col("result"))).otherwise(0)).alias("items"))
    overall = results.agg(F.count("*").alias("total"), F.count_if("success").alias("completed"), F.round(F.coalesce(F.count_if("success") / F.nullif(F.count("*"), F.lit(0)) * 100, F.lit(0.0)), 2).alias("success_rate"), F.round(F.sum("seconds"), 3).alias("seconds"))
    issues = issues_of(results)
    severity = issues.agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))
    return {"by_kind": by_kind, "items": items, "overall": overall, "issues": issues, "severity": severity}


def write_report(report: dict[str, DataFrame], folder: str) -> None:
    """Each table of a report as JSON under ``folder``."""
    for name, df in report.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def unmapped_methods(interfaces: DataFrame, mappers: DataFrame) -> DataFrame:
    """Interface methods without a statement: issues of medium severity."""
    ns = F.concat_ws(".", F.nullif("package", F.lit("")), "class_name")
    methods = interfaces.where(java.has_annotation(F.col("class_annotations"), "Mapper", "Repository")).select(ns.alias("namespace"), F.explode("methods.name").alias("method"))
    done = mapper.method_mapping(interfaces, mappers).select("namespace", "method")
    left = methods.join(done, ["namespace", "method"], "left_anti")
    return left.select(F.lit("unmapped_method").alias("issue"), F.lit("medium").alias("severity"), F.concat_ws(".", "namespace", "method").alias("node_id"), F.lit("no statement of this name").alias("message"))


def unknown_tables(statements: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables that statements name and the dictionary (``name``) lacks, in any case."""
    used = statements.select("namespace", "id", F.explode("tables").alias("t")).withColumn("key", F.upper("t"))
    return used.join(tables.select(F.upper("name").alias("key")), "key", "left_anti").select("namespace", "id", F.col("t").alias("table_name"))


def sql_structure(statements: DataFrame, columns: DataFrame) -> DataFrame:
    """``namespace, id, select_list, conditions, joins, unknown_columns`` of statements, checked against the dictionary (table_name, column_name).

    ``a.b`` names in a statement count as column b of one of its tables; those
    that no table of the statement has are unknown. Statements that name no
    known table have none.
    """
    flat = F.regexp_replace("sql", r"\s+", " ")
    listed = F.regexp_extract(flat, r"(?i)\bselect (?:distinct )?(.*?) from\b", 1)
    s = statements.select(
        "namespace", "id", "tables", F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: x != "").alias("select_list"),
        F.regexp_extract(flat, r"(?i)\bwhere (.*?)(?: group by| order by| having|$)", 1).alias("conditions"), F.size(F.regexp_extract_all(flat, F.lit(r"(?i)\bjoin\b"), F.lit(0))).alias("joins"),
        F.array_distinct(F.transform(F.regexp_extract_all(flat, F.lit(r"\b[A-Za-z_]\w*\.([A-Za-z_]\w*)\b(?! *\()"), F.lit(1)), lambda x: F.upper(x))).alias("used"),
    )
    known = columns.groupBy(F.upper("table_name").alias("t")).agg(F.collect_set(F.upper("column_name")).alias("cols"))
    per = s.select("namespace", "id", F.explode("tables").alias("t")).withColumn("t", F.upper("t")).join(known, "t").groupBy("namespace", "id").agg(F.array_distinct(F.flatten(F.collect_list("cols"))).alias("cols"), F.collect_set("t").alias("named"))
    out = s.join(per, ["namespace", "id"], "left")
    unknown = F.when(F.col("cols").isNotNull(), F.array_sort(F.array_except(F.array_except("used", "cols"), "named"))).otherwise(F.array().cast("array<string>"))
    return out.select("namespace", "id", "select_list", "conditions", "joins", unknown.alias("unknown_columns"))


def transaction_audit(services: DataFrame) -> DataFrame:
    """``class_name, method, problem``: methods of ``java.services`` that call mappers without a transaction, or in one that is read only though a call writes by its name."""
    writes = F.exists("mapper_calls", lambda c: F.lower(c["method"]).rlike("^(?:insert|update|delete|save|remove|store|add|create|merge)"))
    called = services.where(F.size("mapper_calls") > 0)
    none = called.where(~F.col("transactional.enabled") & writes).withColumn("problem", F.lit("write_without_transaction"))
    read = called.where(F.col("transactional.enabled") & (F.col("transactional.read_only") == "true") & writes).withColumn("problem", F.lit("write_in_read_only"))
    return none.unionByName(read).select("class_name", "method", "problem")
