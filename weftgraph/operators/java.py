"""Controllers, services and mapper interfaces: a small reader of class files in source form.

It blanks comments and string bodies, then finds annotations, fields,
constructors, methods and calls by scanning with matched brackets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HTTP_BY_ANNOTATION, http_method

_SKIP = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*.*?\*/', re.S)
_ANNOTATION = re.compile(r"@([A-Za-z_]\w*)(?!\w*\s*\{)")
_CLASS = re.compile(r"\b(?:class|interface|enum)\s+([A-Za-z_]\w*)")
_MEMBER = re.compile(r"([A-Za-z_][\w.]*(?:\s*<[^;{}()]*>)?(?:\s*\[\s*\])*)\s+([A-Za-z_]\w*)\s*\(")
_CALL = re.compile(r"(?:([A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*)\s*\.\s*)?([A-Za-z_]\w*)\s*\(")
_FIELD = re.compile(r"((?:@[A-Za-z_]\w*(?:\s*\([^)]*\))?\s*)*)(?:(?:private|protected|public|final|static|transient|volatile)\s+)*([A-Za-z_][\w.]*(?:\s*<[^;(){}]*>)?)\s+([A-Za-z_]\w*)\s*(?:=[^;]*)?;")
_NOT_CALLS = frozenset("if for while switch catch return new throw synchronized super this assert else do try".split())
_INJECT = frozenset(("Autowired", "Inject", "Resource"))


def blank(source: str) -> str:
    """Comments as blanks and string bodies as spaces; every offset and line stays."""

    def gone(m: re.Match) -> str:
        s = m[0]
        return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1] if s[0] in "\"'" else re.sub(r"[^\n]", " ", s)

    return _SKIP.sub(gone, source)


def closing(code: str, at: int, pair: str = "()") -> int:
    """Place after the bracket that closes the one at ``at``; the end if none does."""
    depth = 0
    for k in range(at, len(code)):
        depth += (code[k] == pair[0]) - (code[k] == pair[1])
        if not depth:
            return k + 1
    return len(code)


def split_top(code: str, source: str, by: str = ",") -> list[str]:
    """Parts of ``source`` at the separators that stand outside all brackets of ``code``."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(code):
        depth += (c in "([{<") - (c in ")]}>")
        if c == by and depth <= 0:
            out.append(source[start:k].strip())
            start = k + 1
    last = source[start:].strip()
    return [*out, last] if last or out else []


def annotations(code: str, source: str) -> list[dict]:
    """``name`` and ``arguments`` of the annotations in a stretch of source; a single value is the argument ``value``.

    The values of an array are the argument's, one a line.
    """
    out, k = [], 0
    while m := _ANNOTATION.search(code, k):
        k = m.end()
        arguments: dict[str, str] = {}
        rest = re.compile(r"\s*\(").match(code, k)
        if rest:
            end = closing(code, rest.end() - 1)
            inner, raw = code[rest.end() : end - 1], source[rest.end() : end - 1]
            for part in split_top(inner, raw):
                key, eq, value = part.partition("=") if re.match(r"\s*\w+\s*=", part) else ("value", "=", part)
                value = value.strip()
                if value.startswith("{") and value.endswith("}"):
                    items = split_top(blank(value[1:-1]), value[1:-1])
                    arguments[key.strip()] = "\n".join(x.strip("\"'") for x in items)
                else:
                    arguments[key.strip()] = value.strip("\"'")
            k = end
        out.append({"name": m[1], "arguments": arguments})
    return out


def parameters(code: str, source: str) -> list[dict]:
    out = []
    for part, raw in zip(split_top(code, code), split_top(code, source), strict=True):
        notes = annotations(part, raw)
        bare = re.sub(r"@\w+(?:\s*\([^)]*\))?|\bfinal\b", " ", part).split()
        if len(bare) >= 2:
            name = next((n["arguments"].get("value", "") for n in notes if n["name"] == "Param"), "")
            out.append({"name": bare[-1], "type": " ".join(bare[:-1]), "annotations": [n["name"] for n in notes], "param_annotation": name})
    return out


def calls(code: str, source: str) -> list[dict]:
    """Calls ``receiver.method(..)`` with the number of arguments; ``this.x`` is the receiver x, no receiver is ''."""
    out = []
    for m in _CALL.finditer(code):
        if m[2] in _NOT_CALLS or re.search(r"\bnew\s+$", code[: m.start()]):
            continue
        receiver = re.sub(r"\s", "", m[1] or "")
        receiver = receiver.removeprefix("this.") if receiver != "this" else ""
        end = closing(code, m.end() - 1)
        inner = code[m.end() : end - 1]
        out.append({"receiver": receiver, "method": m[2], "arguments_count": len(split_top(inner, inner)), "full_expression": source[m.start() : end]})
    return out


def _dependency(kind: str, name: str, how: str) -> dict:
    return {"type": kind, "name": name, "injection_type": how, "is_service": "Service" in kind or "Repository" in kind, "is_mapper": "Mapper" in kind or "Repository" in kind}


def _members(code: str, source: str, start: int, stop: int, own: str, out: dict) -> None:
    """Put methods and dependencies of the class body from ``start`` to ``stop``, and of classes within it, into ``out``."""
    k = member = start
    fields: list[tuple[int, int]] = []
    while k < stop:
        c = code[k]
        if c == "@":
            note = re.compile(r"@[\w.]+\s*(\()?").match(code, k)
            k = closing(code, note.end() - 1) if note and note[1] else (note.end() if note else k + 1)
        elif c == ";":
            fields.append((member, k + 1))
            k = member = k + 1
        elif c == "(":
            end = closing(code, k)
            found = None
            for found in _MEMBER.finditer(code[member : k + 1]):
                pass
            tail = re.compile(r"\s*(?:throws\s+([\w.,\s]+?))?\s*([{;])").match(code, end)
            name = re.search(r"([A-Za-z_]\w*)\s*$", code[member:k])
            if tail and name and "=" not in re.sub(r"@\w+\s*\([^)]*\)", "", code[member:k]):
                body_end = closing(code, tail.end() - 1, "{}") if tail[2] == "{" else tail.end()
                params = parameters(code[k + 1 : end - 1], source[k + 1 : end - 1])
                if name[1] == own:
                    out["dependencies"] += [_dependency(p["type"], p["name"], "constructor") for p in params]
                elif found:
                    first = member + found.start()
                    out["methods"].append({
                        "name": name[1], "return_type": re.sub(r"\s+", "", found[1]), "parameters": params, "annotations": annotations(code[member:first], source[member:first]),
                        "calls": calls(code[tail.end() : body_end], source[tail.end() : body_end]) if tail[2] == "{" else [],
                        "throws": [x.strip() for x in (tail[1] or "").split(",") if x.strip()],
                        "returns": re.findall(r'\breturn\s+"([^"\n]*)"', source[tail.end() : body_end]) if tail[2] == "{" else [],
                    })
                k = member = body_end
            else:
                k = end
        elif c == "{":
            end = closing(code, k, "{}")
            if inner := _CLASS.search(code[member:k]):
                _members(code, source, k + 1, end - 1, inner[1], out)
            k = member = end
        else:
            k += 1
    for a, b in fields:
        m = _FIELD.search(code[a:b])
        if m and _INJECT & {n["name"] for n in annotations(m[1], source[a + m.start(1) : a + m.end(1)])}:
            out["dependencies"].append(_dependency(re.sub(r"\s+", "", m[2]), m[3], "field"))


def parse(source: str) -> dict:
    """The record of one file: package, imports, class, annotations, dependencies, methods (of nested classes, too), exceptions, and whether brackets match."""
    code = blank(source)
    package = re.search(r"\bpackage\s+([\w.]+)\s*;", code)
    cls = _CLASS.search(code)
    out = {
        "package": package[1] if package else "", "imports": [re.sub(r"\s+", " ", x.strip()) for x in re.findall(r"\bimport\s+([^;]+);", code)],
        "class_name": cls[1] if cls else "", "class_annotations": [], "dependencies": [], "methods": [], "exceptions_caught": [], "try_lines": [], "has_errors": any(code.count(a) != code.count(b) for a, b in ("()", "{}")),
    }
    if not cls:
        return out
    head = depth = 0
    for k, c in enumerate(code[: cls.start()]):  # what stands behind the last member or statement; braces in annotations are values
        depth += (c == "(") - (c == ")")
        if c in ";}" and depth <= 0:
            head = k + 1
    out["class_annotations"] = annotations(code[head : cls.start()], source[head : cls.start()])
    start = code.find("{", cls.end())
    if start < 0:
        return out
    _members(code, source, start + 1, closing(code, start, "{}") - 1, cls[1], out)
    out["try_lines"] = [code.count("\n", 0, m.start()) + 1 for m in re.finditer(r"\btry\b\s*[({]", code)]
    caught = [x.strip() for m in re.finditer(r"\bcatch\s*\(\s*(?:final\s+)?([\w.|\s]+?)\s+\w+\s*\)", code) for x in m[1].split("|")]
    out["exceptions_caught"] = list(dict.fromkeys(caught))
    return out


NOTE = "struct<name: string, arguments: map<string, string>>"
RECORD = (
    f"package string, imports array<string>, class_name string, class_annotations array<{NOTE}>, dependencies array<struct<type: string, name: string, injection_type: string, is_service: boolean, is_mapper: boolean>>, "
    f"methods array<struct<name: string, return_type: string, parameters: array<struct<name: string, type: string, annotations: array<string>, param_annotation: string>>, annotations: array<{NOTE}>, "
    "calls: array<struct<receiver: string, method: string, arguments_count: int, full_expression: string>>, throws: array<string>, returns: array<string>>>, exceptions_caught array<string>, try_lines array<int>, has_errors boolean"
)


def extract_classes(files: DataFrame) -> DataFrame:
    """One record a file (``path, content``). Null content gives an empty record."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [parse(c or "") for c in p["content"]]
            yield pd.DataFrame({"path": p["path"], **{k: [g[k] for g in got] for k in parse("")}})

    return files.select("path", "content").mapInPandas(run, f"path string, {RECORD}")


def has_annotation(notes: Column, *names: str) -> Column:
    return F.exists(notes, lambda n: n["name"].isin(list(names)))


def _argument(notes: Column, annotation: tuple[str, ...], *keys: str) -> Column:
    own = F.filter(notes, lambda n: n["name"].isin(list(annotation)))
    args = F.try_element_at(own, F.lit(1))["arguments"]
    return F.coalesce(*[F.try_element_at(args, F.lit(k)) for k in keys])


def _values(given: Column) -> Column:
    """The values of an argument, one at least: those of an array stand a line each."""
    return F.split(F.coalesce(given, F.lit("")), "\n")


def controllers(classes: DataFrame) -> DataFrame:
    """Endpoints: ``class_name, base_path, method, http_method, url_path, params, headers, consumes, produces, calls`` for each path and HTTP method of each mapped method of a controller."""
    c = classes.where(has_annotation(F.col("class_annotations"), "Controller", "RestController"))
    base = _argument(F.col("class_annotations"), ("RequestMapping",), "value", "path")
    m = c.select("path", "package", "class_name", F.explode(_values(base)).alias("base_path"), "methods")
    m = m.select("path", "package", "class_name", "base_path", F.explode("methods").alias("m"))
    maps = tuple(HTTP_BY_ANNOTATION)
    notes = F.col("m.annotations")
    m = m.where(has_annotation(notes, *maps))
    kind = F.try_element_at(F.filter(notes, lambda n: n["name"].isin(list(maps))), F.lit(1))["name"]
    given = F.transform(_values(_argument(notes, maps, "method")), lambda x: F.upper(F.regexp_extract(x, r"(\w+)$", 1)))
    more = {k: F.coalesce(F.array_join(F.filter(_values(_argument(notes, maps, k)), lambda x: x != ""), ","), F.lit("")).alias(k) for k in ("params", "headers", "consumes", "produces")}
    m = m.select("path", "package", "class_name", "base_path", "m", *more.values(), http_method(kind).alias("usual"), F.explode(given).alias("given"), _values(_argument(notes, maps, "value", "path")).alias("paths"))
    m = m.withColumn("own_path", F.explode("paths"))
    return m.select(
        "path", "package", "class_name", "base_path", F.col("m.name").alias("method"), F.when(F.col("given") != "", F.col("given")).otherwise(F.col("usual")).alias("http_method"),
        F.concat("base_path", "own_path").alias("url_path"), F.col("m.return_type").alias("return_type"), *more, F.col("m.calls").alias("calls"), F.col("m.returns").alias("views"),
    )


def controller_statistics(classes: DataFrame) -> DataFrame:
    """``path, class_name, total_methods, request_mappings, dependencies, has_errors`` of each controller."""
    c = classes.where(has_annotation(F.col("class_annotations"), "Controller", "RestController"))
    mapped = F.size(F.filter("methods", lambda m: has_annotation(m["annotations"], *HTTP_BY_ANNOTATION)))
    return c.select("path", "class_name", F.size("methods").alias("total_methods"), mapped.alias("request_mappings"), F.size("dependencies").alias("dependencies"), "has_errors")


def service_statistics(classes: DataFrame) -> DataFrame:
    """``path, class_name, total_methods, transactional_methods, mapper_calls, dependencies, has_errors`` of each service."""
    s = classes.where(has_annotation(F.col("class_annotations"), "Service", "Component"))
    whole = has_annotation(F.col("class_annotations"), "Transactional")
    own = F.size(F.filter("methods", lambda m: whole | has_annotation(m["annotations"], "Transactional")))
    called = F.aggregate("methods", F.lit(0), lambda n, m: n + F.size(F.filter(m["calls"], lambda c: F.lower(c["receiver"]).rlike("mapper|repository|dao"))))
    return s.select("path", "class_name", F.size("methods").alias("total_methods"), own.alias("transactional_methods"), called.alias("mapper_calls"), F.size("dependencies").alias("dependencies"), "has_errors")


def transactional(notes: Column) -> Column:
    """Struct of enabled, propagation, isolation, read_only (any spelling of the key), rollback_for, with the framework's defaults."""
    own = F.try_element_at(F.filter(notes, lambda n: n["name"] == "Transactional"), F.lit(1))["arguments"]
    lower = F.map_from_entries(F.transform(F.map_entries(own), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    get = lambda k, d: F.coalesce(F.regexp_extract(F.try_element_at(lower, F.lit(k)), r"(\w+)(?:[.]class)?$", 1), F.lit(d))
    return F.struct(own.isNotNull().alias("enabled"), get("propagation", "REQUIRED").alias("propagation"), get("isolation", "DEFAULT").alias("isolation"), get("readonly", "false").alias("read_only"), get("rollbackfor", "").alias("rollback_for"))


def services(classes: DataFrame) -> DataFrame:
    """``class_name, transactional, method, throws, mapper_calls, service_calls`` for each method of a service."""
    s = classes.where(has_annotation(F.col("class_annotations"), "Service", "Component"))
    m = s.select("path", "package", "class_name", "class_annotations", F.explode("methods").alias("m"))
    of = lambda words: F.filter("m.calls", lambda c: F.lower(c["receiver"]).rlike(words))
    own = has_annotation(F.col("m.annotations"), "Transactional")
    return m.select("path", "package", "class_name", F.col("m.name").alias("method"), F.when(own, transactional(F.col("m.annotations"))).otherwise(transactional(F.col("class_annotations"))).alias("transactional"), F.col("m.throws").alias("throws"), of("mapper|repository|dao").alias("mapper_calls"), of("service").alias("service_calls"))
