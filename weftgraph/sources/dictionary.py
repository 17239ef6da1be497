"""A database dictionary: tables of the catalogue views, by JDBC or given, joined into one record an object.

The lookups of columns, keys, indexes, foreign keys and triggers are joins, not
a query a table.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

#: Catalogue views that are read.
VIEWS = "user_tables user_tab_columns user_constraints user_cons_columns user_indexes user_ind_columns user_triggers user_views user_sequences user_synonyms user_procedures user_arguments user_source user_dependencies user_scheduler_jobs user_jobs".split()
#: Kinds of object that a procedure can depend on.
DEPENDENCY_KINDS = "TABLE VIEW PROCEDURE FUNCTION PACKAGE SEQUENCE SYNONYM TYPE".split()


def read_dictionary(spark: SparkSession, url: str, user: str, password_env: str) -> dict[str, DataFrame]:
    """All views by JDBC; the password comes from an environment variable of the driver."""
    opts = {"url": url, "user": user, "password": os.environ[password_env], "fetchsize": "1000"}
    return {v: spark.read.format("jdbc").options(dbtable=v, **opts).load() for v in VIEWS}


def _listed(df: DataFrame, key: str, name: str, order: str, *fields: Column) -> DataFrame:
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("position"), *fields))).alias(name))


def columns(d: dict[str, DataFrame]) -> DataFrame:
    c = d["user_tab_columns"]
    kind = t.render_type(F.col("data_type"), F.col("data_length"), F.col("data_precision"), F.col("data_scale"))
    return _listed(c, "table_name", "columns", "column_id", F.col("column_name").alias("name"), kind.alias("type"), (F.col("nullable") == "Y").alias("nullable"))


def key_columns(d: dict[str, DataFrame], kind: str) -> DataFrame:
    """``constraint_name, table_name, columns`` of the constraints of a kind (P, R), columns in order."""
    k = d["user_constraints"].where(F.col("constraint_type") == kind)
    return k.join(_listed(d["user_cons_columns"], "constraint_name", "cols", "position", F.col("column_name").alias("name")), "constraint_name").withColumn("columns", F.col("cols.name"))


def tables(d: dict[str, DataFrame]) -> DataFrame:
    """``name, columns, primary_key, indexes, foreign_keys, triggers``, one row a table."""
    pk = key_columns(d, "P").groupBy("table_name").agg(F.first("columns").alias("primary_key"))
    to = d["user_constraints"].select(F.col("constraint_name").alias("r_constraint_name"), F.col("table_name").alias("references"))
    fk = key_columns(d, "R").join(to, "r_constraint_name", "left").groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct(F.col("constraint_name").alias("name"), "columns", "references"))).alias("foreign_keys"))
    ix = d["user_indexes"].join(_listed(d["user_ind_columns"], "index_name", "cols", "column_position", F.col("column_name").alias("name"), (F.col("descend") == "DESC").alias("descending")), "index_name")
    ix = ix.groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct(F.col("index_name").alias("name"), (F.col("uniqueness") == "UNIQUE").alias("unique"), F.col("cols.name").alias("columns")))).alias("indexes"))
    tr = d["user_triggers"].groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct(F.col("trigger_name").alias("name"), "triggering_event", "status", (F.col("description") if "description" in d["user_triggers"].columns else F.lit(None).cast("string")).alias("description")))).alias("triggers"))
    out = d["user_tables"].select("table_name")
    for part in (columns(d), pk, ix, fk, tr):
        out = out.join(part, "table_name", "left")
    return out.withColumnRenamed("table_name", "name").orderBy("name")


def views(d: dict[str, DataFrame]) -> DataFrame:
    return d["user_views"].join(columns(d).withColumnRenamed("table_name", "view_name"), "view_name", "left").select(F.col("view_name").alias("name"), F.col("text").alias("sql"), "columns")


def sequences(d: dict[str, DataFrame]) -> DataFrame:
    return d["user_sequences"].select(F.col("sequence_name").alias("name"), "min_value", "max_value", "increment_by", (F.col("cycle_flag") == "Y").alias("cycle"), "cache_size", "last_number")


def synonyms(d: dict[str, DataFrame]) -> DataFrame:
    """``name, target, is_remote``: the target is owner.table unless it lies behind a link."""
    local = F.col("db_link").isNull()
    return d["user_synonyms"].select(F.col("synonym_name").alias("name"), "table_owner", "table_name", "db_link", F.when(local & F.col("table_owner").isNotNull(), F.concat_ws(".", "table_owner", "table_name")).when(local, F.col("table_name")).alias("target"), (~local).alias("is_remote"))


def procedures(d: dict[str, DataFrame]) -> DataFrame:
    """``name, full_name, type, parameters, source_code, dependencies``: standalone ones and members of packages."""
    p = d["user_procedures"].where((F.col("object_type") != "PACKAGE") | F.col("procedure_name").isNotNull())
    member = F.col("procedure_name").isNotNull() & (F.col("object_type") == "PACKAGE")
    p = p.select(F.when(member, F.col("object_name")).alias("package"), F.coalesce("procedure_name", "object_name").alias("name"), "object_name", "object_type")
    p = p.withColumn("full_name", F.concat_ws(".", "package", "name"))
    a = d["user_arguments"].withColumn("full_name", F.concat_ws(".", "package_name", "object_name"))
    a = a.groupBy("full_name").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("argument_name", F.lit("RETURN_VALUE")).alias("name"), F.col("data_type").alias("type"), F.col("in_out").alias("mode")))).alias("parameters"))
    s = d["user_source"].groupBy(F.col("name").alias("object_name"), F.col("type").alias("source_type")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "").alias("source_code"))
    dep = d["user_dependencies"].where(F.col("referenced_owner").isNull() | (F.col("referenced_owner") == F.col("owner")))
    dep = dep.where(F.col("referenced_type").isin(DEPENDENCY_KINDS)).groupBy(F.col("name").alias("object_name")).agg(*[F.sort_array(F.collect_set(F.when(F.col("referenced_type") == k, F.col("referenced_name")))).alias(k.lower() + "s") for k in DEPENDENCY_KINDS])
    dep = dep.select("object_name", F.struct(*[k.lower() + "s" for k in DEPENDENCY_KINDS]).alias("dependencies"))
    p = p.withColumn("source_type", F.when(F.col("package").isNotNull(), "PACKAGE BODY").otherwise(F.col("object_type")))
    out = p.join(a, "full_name", "left").join(s, ["object_name", "source_type"], "left").join(dep, "object_name", "left")
    return out.select("name", "full_name", "package", F.col("object_type").alias("type"), "parameters", "source_code", "dependencies")


def jobs(d: dict[str, DataFrame]) -> DataFrame:
    """Scheduler jobs and jobs of the old queue, with the procedure each calls; either source may be missing."""
    out = []
    if "user_scheduler_jobs" in d:
        j = d["user_scheduler_jobs"]
        out.append(j.select("job_name", "job_type", "job_action", (F.col("enabled") == "TRUE").alias("enabled"), F.lit(False).alias("broken")))
    if "user_jobs" in d:
        j = d["user_jobs"]
        out.append(j.select(F.concat(F.lit("JOB_"), F.col("job").cast("string")).alias("job_name"), F.lit("PLSQL_BLOCK").alias("job_type"), F.col("what").alias("job_action"), (F.col("broken") != "Y").alias("enabled"), (F.col("broken") == "Y").alias("broken")))
    rows = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return rows.withColumn("calls_procedure", t.job_procedure(F.col("job_type"), F.col("job_action")))


def summary(d: dict[str, DataFrame]) -> DataFrame:
    """``kind, n`` over all six kinds."""
    parts = {"tables": tables(d), "views": views(d), "sequences": sequences(d), "synonyms": synonyms(d), "procedures": procedures(d), "jobs": jobs(d)}
    out = None
    for k, df in parts.items():
        one = df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def write_all(d: dict[str, DataFrame], folder: str) -> DataFrame:
    """The six kinds as JSON tables under ``folder`` with their counts in ``summary``, which is returned."""
    for kind, of in (("tables", tables), ("views", views), ("sequences", sequences), ("synonyms", synonyms), ("procedures", procedures), ("jobs", jobs)):
        of(d).write.mode("overwrite").json(f"{folder}/{kind}")
    counts = summary(d)
    counts.write.mode("overwrite").json(f"{folder}/summary")
    return counts


def connections(text: str) -> dict[str, dict[str, str]]:
    """Named connections of a configuration text: ``connections:``, then a name a level, then ``key: value`` lines; ``#`` starts a comment.

    A password is named by ``password_env``; one that stands in the text is refused.
    """
    out: dict[str, dict[str, str]] = {}
    inside, name, own = False, "", 0
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip() if not raw.lstrip().startswith("#") else ""
        if not line.strip():
            continue
        depth, (key, _, value) = len(line) - len(line.lstrip()), line.strip().partition(":")
        if depth == 0:
            inside = key == "connections"
        elif inside and not value.strip():
            name, own = key, depth
            out[name] = {}
        elif inside and name and depth > own:
            out[name][key] = value.strip().strip("\"'")
    for name, c in out.items():
        if "password" in c:
            raise ValueError(f"connection {name}: put the password into the environment and name it in password_env")
    return out


def read_connection(spark: SparkSession, text: str, name: str) -> dict[str, DataFrame]:
    """The dictionary of a named connection of the configuration ``text`` (url, user, password_env)."""
    c = connections(text)[name]
    return read_dictionary(spark, c["url"], c["user"], c.get("password_env", f"{name.upper()}_PASSWORD"))
