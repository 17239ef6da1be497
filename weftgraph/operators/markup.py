"""Page templates: includes, forms, calls, URLs, expressions, scriptlets and tag libraries.

Extractors are column functions over ``path, content`` wherever a pattern is
enough; what needs line numbers or nesting goes through one Arrow pass a file.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as t
from . import java

# Patterns of the constructs, as this engine reads them.
STATIC_INCLUDE = r"""(?i)<%@\s*include\s+file\s*=\s*["']([^"']+)["']\s*%>"""
JSP_INCLUDE = r"""(?i)<jsp:include\s[^>]*?page\s*=\s*["']([^"']+)["'][^>]*>"""
IMPORT = r"""(?i)<c:import\s[^>]*?url\s*=\s*["']([^"']+)["'][^>]*>"""
TAGLIB = r"""<%@\s*taglib\s+prefix\s*=\s*["']([^"']+)["']\s+uri\s*=\s*["']([^"']+)["']\s*%>"""
SCRIPTLET = r"(?s)<%(?![@=!-])(.*?)%>"
SCRIPT_EXPRESSION = r"(?s)<%=(.*?)%>"
AJAX = r"""(?s)\$[.]ajax\(\s*[{]([^}]*)[}]"""
JQUERY_SHORT = r"""\$[.](get|post)\(\s*["']([^"']+)["']"""
FETCH = r"""fetch\(\s*["'`]([^"'`]+)["'`](?:\s*,\s*[{][^}]*?method\s*:\s*["'](\w+)["'])?"""
XHR = r"""[.]open\(\s*["'](\w+)["']\s*,\s*["']([^"']+)["']"""
LINK_HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""
#: The same links with what stands up to their end or the next link.
LINK_SHOWN = r"""(?is)<a\s[^>]*?href\s*=\s*["'][^"']*["'][^>]*>?(.*?)(?=</a|<a\s|\z)"""
ASSET = r"""(?i)<(?:script|img|iframe)\s[^>]*?src\s*=\s*["']([^"']+)["']"""
STYLESHEET = r"""(?i)<link\s[^>]*?href\s*=\s*["']([^"']+)["']"""
SCRIPTED_URL = r"""(?:location[.]href\s*=|window[.]open\()\s*["']([^"']+)["']"""
TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def all_of(content: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(pattern), F.lit(group))


def ajax_calls(content: Column) -> Column:
    """Array of ``kind, url, method`` over jQuery, fetch and XHR calls. Option objects with nested braces are not read past the first."""
    url = lambda b: F.regexp_extract(b, r"""url\s*:\s*["']([^"']+)["']""", 1)
    verb = lambda b: F.upper(F.coalesce(F.nullif(F.regexp_extract(b, r"""(?:type|method)\s*:\s*["'](\w+)["']""", 1), F.lit("")), F.lit("GET")))
    row = lambda kind, u, m: F.struct(F.lit(kind).alias("kind"), u.alias("url"), m.alias("method"))
    full = F.filter(F.transform(all_of(content, AJAX), lambda b: row("jquery_ajax", url(b), verb(b))), lambda r: r["url"] != "")
    short = F.zip_with(all_of(content, JQUERY_SHORT, 1), all_of(content, JQUERY_SHORT, 2), lambda m, u: row("jquery_short", u, F.upper(m)))
    fetched = F.zip_with(all_of(content, FETCH, 1), all_of(content, FETCH, 2), lambda u, m: row("fetch", u, F.upper(F.coalesce(F.nullif(m, F.lit("")), F.lit("GET")))))
    xhr = F.zip_with(all_of(content, XHR, 1), all_of(content, XHR, 2), lambda m, u: row("xhr", u, F.upper(m)))
    return F.concat(full, short, fetched, xhr)


def page_urls(content: Column) -> Column:
    """Array of ``kind, url, classification, text`` of links, assets and scripted URLs; text: what a link shows, without tags, up to 50 characters."""
    row = lambda kind, u, text: F.struct(F.lit(kind).alias("kind"), u.alias("url"), t.classify_url(u).alias("classification"), text.alias("text"))
    of = lambda kind, p: F.transform(all_of(content, p), lambda u: row(kind, u, F.lit(None).cast("string")))
    shown = lambda x: F.substring(F.trim(F.regexp_replace(x, r"(?s)<[^>]*>", "")), 1, config.LINK_TEXT)
    links = F.zip_with(all_of(content, LINK_HREF), all_of(content, LINK_SHOWN), lambda u, x: row("link", u, shown(x)))
    return F.concat(links, of("asset", ASSET), of("stylesheet", STYLESHEET), of("script", SCRIPTED_URL))


def taglibs(content: Column) -> Column:
    return F.zip_with(all_of(content, TAGLIB, 1), all_of(content, TAGLIB, 2), lambda p, u: F.struct(p.alias("prefix"), u.alias("uri")))


def resolve_path(path: str, target: str, root: str | None = None) -> str:
    """``/x`` from ``root``, the folder that holds WEB-INF (else the path's own first WEB-INF parent, else beside ``path``); others beside ``path``."""
    if not target.startswith("/"):
        return posixpath.normpath(posixpath.join(posixpath.dirname(path), target))
    if root is None:
        root = path.split("/WEB-INF/")[0] if "/WEB-INF/" in path else posixpath.dirname(path)
    return posixpath.normpath(f"{root}{target}".lstrip("/") if not root else root + target)


def with_root(pages: DataFrame, listing: DataFrame) -> DataFrame:
    """``pages`` (path, ..) with ``root``: the nearest folder above the page that holds WEB-INF among the files of ``listing`` (path); null if none does."""
    held = F.regexp_extract(F.concat(F.lit("/"), F.translate("path", "\\", "/")), "^(.*?)/WEB-INF/", 1)
    inside = F.concat(F.lit("/"), F.translate("path", "\\", "/")).contains("/WEB-INF/")
    roots = listing.where(inside).select(held.alias("dir")).distinct()
    parts = F.split(F.concat(F.lit("/"), F.translate("path", "\\", "/")), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    near = pages.select("path", F.explode(above).alias("dir")).distinct().join(roots, "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("_dir"))
    return pages.join(near, "path", "left").withColumn("root", F.regexp_replace("_dir", "^/", "")).drop("_dir")


class _Forms(HTMLParser):
    """Forms with their fields."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.forms: list[dict] = []
        self.open: dict | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "form":
            self.open = {"action": a.get("action", ""), "method": (a.get("method") or "GET").upper(), "inputs": []}
            self.forms.append(self.open)
        elif tag in ("input", "select", "textarea") and self.open is not None:
            kind = a.get("type", "text") if tag == "input" else tag
            self.open["inputs"].append({"name": a.get("name", ""), "type": kind, "required": "required" in a})

    def handle_endtag(self, tag: str) -> None:
        if tag == "form":
            self.open = None


INCLUDES = "array<struct<kind: string, target: string, resolved_path: string, flush: string, line: int>>"
FORMS = "array<struct<action: string, method: string, inputs: array<struct<name: string, type: string, required: boolean>>>>"
LINED = "array<struct<kind: string, text: string, line: int, has_errors: boolean>>"
EXPRESSIONS = "array<struct<kind: string, expression: string, variables: array<string>, line: int>>"


def _parse(path: str, content: str, root: str | None = None) -> dict:
    line = lambda at: content.count("\n", 0, at) + 1

    def include(kind: str, m: re.Match) -> dict:
        flush = re.search(r"""\bflush\s*=\s*["'](\w+)["']""", m[0]) if kind == "dynamic" else None
        return {"kind": kind, "target": m[1], "resolved_path": resolve_path(path, m[1], root), "flush": (flush[1] if flush else "false") if kind == "dynamic" else None, "line": line(m.start())}

    includes = [include(k, m) for k, p in (("static", STATIC_INCLUDE), ("dynamic", JSP_INCLUDE), ("import", IMPORT)) for m in re.finditer(p, content)]
    broken = lambda code: any(code.count(a) != code.count(b) for a, b in ("()", "[]"))  # noqa: E731  braces may close in a later scriptlet
    scripts = [{"kind": k, "text": m[1].strip(), "line": line(m.start()), "has_errors": broken(java.blank(m[1]))} for k, p in (("code", SCRIPTLET), ("expression", SCRIPT_EXPRESSION)) for m in re.finditer(p, content)]
    expressions = [
        {"kind": k, "expression": m[1].strip(), "variables": [x.strip() for x in re.split(r"[.\[(]", m[1].strip()) if x.strip()[:1].isalpha()], "line": line(m.start())}
        for k, p in (("standard", r"[$][{]([^}]*)[}]"), ("spring", r"#[{]([^}]*)[}]")) for m in re.finditer(p, content)
    ]
    forms = _Forms()
    forms.feed(content)
    return {"includes": includes, "scriptlets": scripts, "forms": forms.forms, "el_expressions": expressions}


def extract_pages(files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """One record a page (``path, content``): includes, forms, calls, URLs, expressions, scriptlets, taglibs, counts. Null content is empty.

    ``listing`` (path) names all files of the project, so that includes from
    the root are found; the pages themselves by default. Unit ids end with a
    number of four digits among the pages whose paths give the same letters.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            roots = [r if isinstance(r, str) else None for r in p["root"]]
            got = [_parse(a, b or "", r) for a, b, r in zip(p["path"], p["content"], roots, strict=True)]
            yield p.assign(**{k: [g[k] for g in got] for k in ("includes", "scriptlets", "forms", "el_expressions")}).drop(columns="root")

    rooted = with_root(files.select("path", "content"), (listing if listing is not None else files).select("path")).select("path", "content", "root")
    parsed = rooted.mapInPandas(run, f"path string, content string, includes {INCLUDES}, scriptlets {LINED}, forms {FORMS}, el_expressions {EXPRESSIONS}")
    c = F.col("content")
    letters = F.translate("path", "/\\.", "___")
    nth = F.row_number().over(Window.partitionBy(letters).orderBy("path"))
    out = parsed.withColumn("nth", nth).select(
        "path", F.concat(F.lit("cu_"), letters, F.lit("_"), F.lpad(F.col("nth").cast("string"), 4, "0")).alias("compilation_unit_id"), "includes", "forms", "scriptlets",
        ajax_calls(c).alias("ajax_calls"), page_urls(c).alias("urls"), "el_expressions", taglibs(c).alias("taglibs"),
    )
    counts = [F.size(k).alias(k) for k in ("includes", "forms", "scriptlets", "ajax_calls", "urls", "el_expressions", "taglibs")]
    return out.withColumn("statistics", F.struct(*counts))


def web_xml_includes(xml: Column) -> Column:
    """Array of ``applies_to, preludes, codas`` of the property groups in a web.xml, whatever its namespace."""
    bare = F.regexp_replace(F.regexp_replace(xml, r'\sxmlns(?::\w+)?="[^"]*"|\s\w+:schemaLocation="[^"]*"', ""), r"(?s)<!DOCTYPE[^>]*>", "")
    groups = F.regexp_extract_all(bare, F.lit(r"(?s)<jsp-property-group>(.*?)</jsp-property-group>"), F.lit(1))
    inner = lambda g, tag: F.transform(F.regexp_extract_all(g, F.lit(rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>"), F.lit(1)), lambda x: F.trim(x))
    return F.transform(groups, lambda g: F.struct(inner(g, "url-pattern").alias("applies_to"), inner(g, "include-prelude").alias("preludes"), inner(g, "include-coda").alias("codas")))
