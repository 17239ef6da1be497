"""Queries on pages, documents, events and texts made from parts and suppliers: URLs, SQL text, hashes, caches, limits, callers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import markup, procedures, urls, verify
from .registry import query

#: Endpoint templates that the pages' URLs are matched with.
TEMPLATES = [(1, "/{lang}/{id}", ["GET"]), (2, "/{lang}/*", ["POST"]), (3, "/**", ["PUT"]), (4, "/fr/{id}", ["GET"])]
#: Statements over the parts: seven forms with the part's key in their names. Spark and the oracle run the same text.
STATEMENT_TEXTS = """
SELECT p_partkey AS id, p_partkey % 7 AS form,
  CASE p_partkey % 7 WHEN 0 THEN 'SELECT a FROM app.users' || p_partkey || ' u JOIN orders' || p_partkey || ' o ON u.id = o.uid /* ' || p_name || ' */'
    WHEN 1 THEN '{{CALL pkg.sync_' || p_partkey || '(#{{id' || p_partkey || '}})}}'
    WHEN 2 THEN 'insert into Logs' || p_partkey || ' values (#{{msg' || p_partkey || ',jdbcType=VARCHAR}}, ' || '$' || '{{t}})'
    WHEN 3 THEN 'update stock' || p_partkey || ' set n = n - #{{n}}'
    WHEN 4 THEN 'select 1 from a' || p_partkey || ', b x, c.d where RECALL = ' || p_partkey
    WHEN 5 THEN 'EXEC refresh_' || p_partkey ELSE 'delete from t' || p_partkey END AS sql,
  CASE WHEN p_partkey % 7 = 6 THEN 'CALLABLE' ELSE '' END AS kind
FROM {part}
"""
JOB_TEXTS = """
SELECT 'J' || s_suppkey AS job_name, s_suppkey % 4 AS form, CASE s_suppkey % 4 WHEN 0 THEN 'STORED_PROCEDURE' ELSE 'PLSQL_BLOCK' END AS job_type,
  CASE s_suppkey % 4 WHEN 0 THEN 'SYNC_' || s_suppkey WHEN 1 THEN 'BEGIN pkg.refresh_' || s_suppkey || '(1); END;' WHEN 2 THEN 'call clean_' || s_suppkey ELSE 'null;' END AS job_action
FROM {supplier}
"""


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


PATH_SQL = "regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', '')"


def _page_calls(spark, sf) -> DataFrame:
    p = _table(spark, sf, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", "")
    return p.select(F.col("page_id").alias("call_id"), path.alias("url"), F.lit("GET").alias("method"))


def _endpoints(spark) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "endpoint_id int, template string, methods array<string>")


@query(f"SELECT page_id, regexp_replace('/' || {PATH_SQL}, '/+', '/', 'g') AS path FROM pages")
def url_normalize(spark, sf):
    return _page_calls(spark, sf).select(F.col("call_id").alias("page_id"), t.normalize_url(F.col("url")).alias("path"))


CANDIDATES = f"""p AS (SELECT page_id AS call_id, {PATH_SQL} AS url, regexp_replace('/' || {PATH_SQL}, '/+', '/', 'g') AS path FROM pages),
c AS (SELECT call_id, url, 1 AS endpoint_id, '/{{lang}}/{{id}}' AS template FROM p WHERE regexp_matches(path, '^/[^/]+/[^/]+$')
UNION ALL SELECT call_id, url, 4, '/fr/{{id}}' FROM p WHERE regexp_matches(path, '^/fr/[^/]+$'))"""


@query(f"WITH {CANDIDATES} SELECT call_id, url, endpoint_id, template, false AS exact FROM c")
def url_candidates(spark, sf):
    return urls.candidates(_page_calls(spark, sf), _endpoints(spark))


@query(f"WITH {CANDIDATES}, k AS (SELECT call_id, count(*) AS k, min(endpoint_id) AS e FROM c GROUP BY 1) SELECT p.call_id, url, CASE WHEN k = 1 THEN e END AS endpoint_id, CASE WHEN k = 1 THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN k = 1 THEN 'pattern_match' WHEN k > 1 THEN 'llm' ELSE 'no_match' END AS method FROM p LEFT JOIN k ON p.call_id = k.call_id")
def url_match(spark, sf):
    return urls.match(_page_calls(spark, sf), _endpoints(spark))


@query("""WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) FROM pages)
SELECT page_id, url, CASE WHEN trim(url) = '' OR url LIKE '#%' THEN 'anchor' WHEN regexp_matches(url, '^(https?:)?//') THEN 'external' WHEN lower(regexp_replace(url, '[?#].*$', '')) LIKE '%.jsp' THEN 'jsp'
 WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '[.](css|js|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|eot|pdf|map)$') THEN 'static' WHEN contains(url, '${') OR contains(url, '<%=') THEN 'dynamic_expression' ELSE 'controller' END AS classification FROM u""")
def url_classify(spark, sf):
    p = _table(spark, sf, "pages")
    links = p.select("page_id", F.explode(markup.all_of(F.col("html"), markup.LINK_HREF)).alias("url"))
    return p.select("page_id", "url").unionByName(links).withColumn("classification", t.classify_url(F.col("url")))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages""")
def page_links(spark, sf):
    return _table(spark, sf, "pages").select("page_id", F.explode(markup.all_of(F.col("html"), markup.LINK_HREF)).alias("href"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<script'))::INT AS scripts FROM pages")
def page_scripts(spark, sf):
    return _table(spark, sf, "pages").select("page_id", F.size(markup.all_of(F.col("html"), "(?i)<script", 0)).alias("scripts"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def page_titles(spark, sf):
    return _table(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract("html", markup.TITLE, 1)).alias("title"))


@query("SELECT page_id, unnest(['standard', 'spring']) AS kind, unnest(['user' || page_id || '.name', 'cfg[' || page_id || ']']) AS expression, unnest(['user' || page_id || ',name', 'cfg']) AS variables FROM pages")
def el_expressions(spark, sf):
    """Every page with two expressions behind its own text."""
    key = F.col("page_id").cast("string")
    page = F.concat(F.col("html"), F.lit("<p>${ user"), key, F.lit(".name } #{cfg["), key, F.lit("]}</p>"))
    e = _table(spark, sf, "pages").select("page_id", F.explode(t.el_expressions(page)).alias("e"))
    return e.select("page_id", "e.kind", "e.expression", F.array_join("e.variables", ",").alias("variables"))


@query("SELECT page_id, unnest(['jquery_ajax', 'jquery_short', 'fetch', 'xhr']) AS kind, unnest(['/d/' || page_id, '/a/' || page_id, '/b' || page_id, '/c']) AS url, unnest(['DELETE', 'GET', 'PUT', 'POST']) AS method FROM pages")
def ajax_calls(spark, sf):
    """Every page with four calls behind its own text."""
    key = F.col("page_id").cast("string")
    script = F.concat(F.lit('<script>$.get("/a/'), key, F.lit('"); fetch("/b'), key, F.lit('", {method: "put"}); x.open("POST", "/c"); $.ajax({type: "delete", url: \'/d/'), key, F.lit("'});</script>"))
    return _table(spark, sf, "pages").select("page_id", F.explode(markup.ajax_calls(F.concat("html", script))).alias("c")).select("page_id", "c.kind", "c.url", "c.method")


def _statements(spark, sf) -> DataFrame:
    return spark.sql(STATEMENT_TEXTS, part=_table(spark, sf, "part"))


STATEMENTS = f"s AS ({STATEMENT_TEXTS.format(part='part')})"


@query(f"WITH {STATEMENTS} SELECT id, CASE form WHEN 0 THEN 'orders' || id || ',users' || id WHEN 2 THEN 'Logs' || id WHEN 3 THEN 'stock' || id WHEN 4 THEN 'a' || id || ',b,d' WHEN 6 THEN 't' || id ELSE '' END AS tables FROM s")
def sql_table_names(spark, sf):
    return _statements(spark, sf).select("id", F.array_join(t.sql_tables(F.col("sql")), ",").alias("tables"))


@query(f"WITH {STATEMENTS} SELECT id, CASE form WHEN 1 THEN 'id' || id WHEN 2 THEN 'msg' || id || ',t' WHEN 3 THEN 'n' ELSE '' END AS parameters FROM s")
def sql_parameters(spark, sf):
    return _statements(spark, sf).select("id", F.array_join(t.sql_parameters(F.col("sql")), ",").alias("parameters"))


@query(f"WITH {STATEMENTS} SELECT id, form IN (1, 5, 6) AS is_callable, CASE form WHEN 1 THEN 'sync_' || id WHEN 5 THEN 'refresh_' || id END AS procedure_name FROM s")
def callable_procedures(spark, sf):
    return _statements(spark, sf).select("id", t.is_callable(F.col("sql"), F.col("kind")).alias("is_callable"), t.procedure_name(F.col("sql")).alias("procedure_name"))


def _jobs(spark, sf) -> DataFrame:
    return spark.sql(JOB_TEXTS, supplier=_table(spark, sf, "supplier"))


@query(f"SELECT job_name, CASE form WHEN 0 THEN 'SYNC_' || substr(job_name, 2) WHEN 1 THEN 'PKG.REFRESH_' || substr(job_name, 2) WHEN 2 THEN 'CLEAN_' || substr(job_name, 2) ELSE 'NULL' END AS calls_procedure FROM ({JOB_TEXTS.format(supplier='supplier')}) AS j")
def job_procedure_calls(spark, sf):
    return _jobs(spark, sf).select("job_name", t.job_procedure(F.col("job_type"), F.col("job_action")).alias("calls_procedure"))


@query(f"""WITH {STATEMENTS}, j AS ({JOB_TEXTS.format(supplier='supplier')}), p AS (SELECT 'sync_' || p_partkey AS name FROM part UNION ALL SELECT 'refresh_' || p_partkey FROM part UNION ALL SELECT 'never_' || p_partkey FROM part)
SELECT name AS procedure, 'statement:' || id AS caller FROM p JOIN s ON form = 1 AND name = 'sync_' || id OR form = 5 AND name = 'refresh_' || id
UNION ALL SELECT name, 'job:' || job_name FROM p JOIN j ON form = 0 AND name = 'sync_' || substr(job_name, 2) OR form = 1 AND name = 'refresh_' || substr(job_name, 2)""")
def procedure_callers(spark, sf):
    names = F.explode(F.array(*(F.concat(F.lit(x), F.col("p_partkey").cast("string")) for x in ("sync_", "refresh_", "never_")))).alias("name")
    procs = _table(spark, sf, "part").select(names)
    s = callable_procedures(spark, sf).withColumn("namespace", F.lit("ns"))
    j = _jobs(spark, sf).withColumns({"enabled": F.lit(True), "broken": F.lit(False)})
    a = procedures.statement_callers(procs, s).select("procedure", F.concat(F.lit("statement:"), F.col("statement_id").cast("string")).alias("caller"))
    return a.unionByName(procedures.job_callers(procs, j).select("procedure", F.concat(F.lit("job:"), "job_name").alias("caller")))


NORMAL = r"""regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)//[^\n]*$', '', 'g'), '(?m)#[^\n]*$', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '[ \t\r\n\f]+', ' ', 'g')), ' ?([{}();,=+<>*/!&|:?-]) ?', '\1', 'g')"""


@query(f"SELECT doc_id, sha256({NORMAL} || ':text') AS hash FROM documents")
def semantic_hash(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", t.semantic_hash(F.col("text"), F.lit("text")).alias("hash"))


@query(f"SELECT sha256({NORMAL} || ':text') AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_code(spark, sf):
    h = semantic_hash(spark, sf)
    return h.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("SELECT event_id, user_id, count(*) OVER w AS in_window, count(*) OVER w <= 60 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW)")
def rate_limit_window(spark, sf):
    return verify.rate_window(_table(spark, sf, "events")).select("event_id", "user_id", "in_window", "allowed")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS")
def cache_ttl(spark, sf):
    e = _table(spark, sf, "events")
    last = e.agg(F.max("ts")).head()[0]
    return verify.fresh(e.withColumnRenamed("ts", "cached_at"), F.lit(last)).select("event_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 3 OR doc_id % 7 = 2")
def changed_files(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "n_chars")
    now = d.withColumn("fingerprint", verify.fingerprint(F.col("path"), F.lit(1), F.col("n_chars")))
    old = d.where("doc_id % 10 <> 3").withColumn("fingerprint", verify.fingerprint(F.col("path"), F.when(F.col("doc_id") % 7 == 2, 0).otherwise(1), F.col("n_chars")))
    return verify.changed_files(now, old).select("doc_id")


@query("SELECT event_type AS kind, count(*) AS total, count(*) FILTER (value > 50) AS completed, round(count(*) FILTER (value > 50) * 100.0 / count(*), 2) AS success_rate FROM events GROUP BY 1")
def batch_success(spark, sf):
    return verify.batch_summary(_table(spark, sf, "events").select(F.col("event_type").alias("kind"), (F.col("value") > 50).alias("success")))


@query("SELECT count(*) FILTER (value > 50) AS hits, count(*) FILTER (NOT value > 50) AS misses, round(count(*) FILTER (value > 50) / count(*), 3) AS hit_rate, (7 * count(*) FILTER (value > 50))::BIGINT AS tokens_saved, round(7 * count(*) FILTER (value > 50) / 1000 * 0.003, 4) AS cost_saved FROM events")
def verifier_cache_stats(spark, sf):
    return verify.cache_stats(_table(spark, sf, "events").select((F.col("value") > 50).alias("hit"), F.lit(7).cast("long").alias("tokens")))
