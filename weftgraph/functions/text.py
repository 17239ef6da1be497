"""Column functions on URLs, SQL and source text; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns by which table names are found in SQL, group 1 each. They also match FOR UPDATE x and EXTRACT(.. FROM x).
TABLE_PATTERNS = (
    r"(?i)\bFROM\s+([A-Za-z_][A-Za-z0-9_.]*)",
    r"(?i)\bJOIN\s+([A-Za-z_][A-Za-z0-9_.]*)",
    r"(?i)\bINTO\s+([A-Za-z_][A-Za-z0-9_.]*)",
    r"(?i)\bUPDATE\s+([A-Za-z_][A-Za-z0-9_.]*)",
)
COMMA_LIST = r"(?i)\bFROM\s+([A-Za-z_][A-Za-z0-9_. ]*(?:,\s*[A-Za-z_][A-Za-z0-9_. ]*)+)"
#: Words that follow a table in place of an alias, or cannot be a table.
SQL_WORDS = ("select", "where", "set", "values", "on", "using", "left", "right", "inner", "outer", "full", "cross", "group", "order", "having", "limit", "union")
#: File endings that are served as they are.
STATIC = ("css", "js", "png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2", "ttf", "eot", "pdf", "map")
HTTP_BY_ANNOTATION = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "GET"}


def classify_url(url: Column) -> Column:
    """anchor, external, jsp, static, dynamic_expression or controller, by the first rule that holds."""
    u = F.trim(F.coalesce(url, F.lit("")))
    path = F.regexp_replace(u, "[?#].*$", "")
    return (
        F.when((u == "") | u.startswith("#"), "anchor")
        .when(u.rlike("^(?:https?:)?//"), "external")
        .when(F.lower(path).endswith(".jsp"), "jsp")
        .when(F.lower(path).rlike(r"[.](?:" + "|".join(STATIC) + ")$"), "static")
        .when(u.contains("${") | u.contains("<%="), "dynamic_expression")
        .otherwise("controller")
    )


def normalize_url(url: Column) -> Column:
    """A called URL as a path: quotes and ${..} gone, no query, joined parts as ``{var}``, one slash at a time."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), r"[$][{][^}]*[}]", "")
    parts = F.transform(F.split(u, r"\+"), lambda p: F.trim(F.regexp_replace(F.trim(p), "[\"'`]", "")))
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.when(p.startswith("/"), p).otherwise(F.lit("{var}"))), "")
    u = F.when(u.contains("+"), joined).otherwise(F.trim(F.regexp_replace(u, "[\"'`]", "")))
    u = F.regexp_replace(u, "[?].*$", "")
    return F.regexp_replace(F.concat(F.lit("/"), u), "/+", "/")


def url_pattern(template: Column) -> Column:
    """The regular expression of an endpoint template: ``{v}`` and ``*`` are one segment, ``**`` is anything."""
    p = F.regexp_replace(template, r"[.]", "[.]")
    p = F.regexp_replace(p, r"\*\*", "\u0001")
    p = F.regexp_replace(p, r"\*|[{][^}/]*[}]", "[^/]+")
    return F.concat(F.lit("^"), F.regexp_replace(p, "\u0001", ".*"), F.lit("$"))


def segments(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def sql_tables(sql: Column) -> Column:
    """Sorted distinct table names: after FROM, JOIN, INTO, UPDATE and in comma lists; schema and alias dropped, case kept."""
    s = F.coalesce(sql, F.lit(""))
    direct = [F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in TABLE_PATTERNS]
    listed = F.flatten(F.transform(F.regexp_extract_all(s, F.lit(COMMA_LIST), F.lit(1)), lambda x: F.transform(F.split(x, ","), lambda t: F.split(F.trim(t), r"\s+")[0])))
    bare = F.transform(F.concat(*direct, listed), lambda t: F.element_at(F.split(t, "[.]"), -1))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda t: (t != "") & ~F.lower(t).isin(list(SQL_WORDS)))))


def sql_parameters(sql: Column) -> Column:
    """Sorted distinct names in ``#{name, ..}`` and ``${name}``."""
    s = F.coalesce(sql, F.lit(""))
    found = F.concat(F.regexp_extract_all(s, F.lit(r"#[{]\s*([^},\s]+)"), F.lit(1)), F.regexp_extract_all(s, F.lit(r"[$][{]\s*([^},\s]+)"), F.lit(1)))
    return F.array_sort(F.array_distinct(found))


def is_callable(sql: Column, statement_type: Column | None = None) -> Column:
    """Whether a statement calls a procedure: CALL or EXEC as a word, or statement type CALLABLE."""
    words = F.coalesce(sql, F.lit("")).rlike(r"(?i)(?:^|[^A-Za-z0-9_])(?:call\s|exec(?:ute)?\s)")
    return words if statement_type is None else words | (F.upper(F.coalesce(statement_type, F.lit(""))) == "CALLABLE")


def procedure_name(sql: Column) -> Column:
    """Last dotted part of what a statement calls; null if it calls nothing."""
    found = F.regexp_extract(F.coalesce(sql, F.lit("")), r"(?i)(?:^|[^A-Za-z0-9_])(?:call|exec|execute)\s+([A-Za-z0-9_$.]+)", 1)
    return F.nullif(F.element_at(F.split(found, "[.]"), -1), F.lit(""))


def job_procedure(kind: Column, action: Column) -> Column:
    """The procedure a scheduler job calls: its action itself, or the first call in a block, in upper case."""
    a = F.upper(F.coalesce(action, F.lit("")))
    tries = [F.nullif(F.regexp_extract(a, p, 1), F.lit("")) for p in (r"BEGIN\s+([A-Z0-9_$.]+)\s*[(;]", r"CALL\s+([A-Z0-9_$.]+)", r"EXEC(?:UTE)?\s+([A-Z0-9_$.]+)", r"^\s*([A-Z0-9_$.]+)\s*[(;]")]
    return F.when(F.upper(kind) == "STORED_PROCEDURE", F.trim(action)).otherwise(F.coalesce(*tries))


def el_expressions(text: Column) -> Column:
    """Array of ``kind, expression, variables``: ``${..}`` standard, ``#{..}`` spring."""
    t = F.coalesce(text, F.lit(""))
    of = lambda kind, mark: F.transform(F.regexp_extract_all(t, F.lit(mark + r"[{]([^}]*)[}]"), F.lit(1)), lambda e: F.struct(F.lit(kind).alias("kind"), F.trim(e).alias("expression"), el_variables(F.trim(e)).alias("variables")))
    return F.concat(of("standard", "[$]"), of("spring", "#"))


def el_variables(expression: Column) -> Column:
    """Parts of an expression between ``. [ (`` that start with a letter, trimmed."""
    return F.filter(F.transform(F.split(expression, r"[.\[(]"), lambda p: F.trim(p)), lambda p: p.rlike(r"^\p{L}"))


def semantic_normalize(code: Column) -> Column:
    """Source text without comments and needless blanks; everything after // or # on a line counts as comment."""
    c = F.regexp_replace(F.coalesce(code, F.lit("")), r"(?m)//[^\n]*$", "")
    c = F.regexp_replace(c, r"(?m)#[^\n]*$", "")
    c = F.regexp_replace(c, r"(?s)/\*.*?\*/", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.trim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))
    return F.regexp_replace(c, r" ?([{}();,=+<>*/!&|:?-]) ?", "$1")


def semantic_hash(code: Column, kind: Column) -> Column:
    return F.sha2(F.concat(semantic_normalize(code), F.lit(":"), kind).cast("binary"), 256)


def render_type(data_type: Column, length: Column, precision: Column, scale: Column) -> Column:
    """A dictionary column's type as text: VARCHAR2(n), NUMBER(p,s) where the scale is over 0, NUMBER(p)."""
    t = F.upper(data_type)
    return (
        F.when(t.isin("VARCHAR2", "CHAR", "NVARCHAR2", "NCHAR", "RAW") & length.isNotNull(), F.concat(t, F.lit("("), length.cast("string"), F.lit(")")))
        .when((t == "NUMBER") & precision.isNotNull() & (F.coalesce(scale, F.lit(0)) > 0), F.concat(F.lit("NUMBER("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")")))
        .when((t == "NUMBER") & precision.isNotNull(), F.concat(F.lit("NUMBER("), precision.cast("string"), F.lit(")")))
        .otherwise(t)
    )


def http_method(annotation: Column) -> Column:
    out = F.lit("UNKNOWN")
    for name, method in HTTP_BY_ANNOTATION.items():
        out = F.when(annotation == name, method).otherwise(out)
    return out
