"""Secret scans with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams
that every match must hold. Slices of about 2 MB of a partition are index
segments: postings of the trigrams that any rule needs are built over the
segment (each text is searched for each of them), intersected and united as the
query says, and only candidates are verified with the regular expression. A
rule without mandatory trigrams scans its whole segment. Segments need no
shuffle, so a lost executor costs its segments only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, text_or_empty

#: (kind, pattern, flags, group to measure, least length). The first three are the base kinds.
RULES: tuple[tuple[str, str, int, int, int], ...] = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", re.A, 0, 18),
    ("hex", r"[0-9a-f]+", re.A, 0, 16),
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----", re.A, 0, 1),
    ("forge_token", r"gh[pousr]_[A-Za-z0-9]{30,}", re.A, 0, 1),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", re.A, 0, 1),
    ("map_key", r"AIza[0-9A-Za-z_-]{35}", re.A, 0, 1),
    ("pay_key", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}", re.A, 0, 1),
    ("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.A, 0, 1),
    ("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", re.A, 0, 1),
)
BASE = 3

#: Strings that one stretch of a pattern may expand to before it counts as unknown.
EXPAND = 64

# A query is True (no constraint), a trigram, or ("and"|"or", frozenset of queries).


def _join(op: str, parts: list):
    parts = list(dict.fromkeys(parts))
    if op == "and":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]):
    """Any of ``strings`` occurs: the trigrams of one of them all occur."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(tokens, current: set[str], found: list) -> set[str]:
    """Extend ``current``, the strings the match may end with so far; flush into ``found`` where they get unknown."""

    def flush() -> None:
        nonlocal current
        found.append(_of_strings(current))
        current = {""}

    def extend(options: set[str]) -> None:
        nonlocal current
        if len(current) * len(options) > EXPAND:
            flush()
        current = {a + b for a in current for b in options} if len(options) <= EXPAND else {""}

    for op, av in tokens:
        if op is sre.LITERAL:
            extend({chr(av).lower()})
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in av) and len(av) <= 6:
            extend({chr(c).lower() for _, c in av})
        elif op is sre.SUBPATTERN:
            current = _walk(av[3], current, found)
        elif op is sre.BRANCH:
            ends, queries = [], []
            for branch in av[1]:
                inner: list = []
                ends.append(_walk(branch, {""}, inner))
                queries.append(inner)
            if any(queries):
                flush()
                found.append(_join("or", [_join("and", [*q, _of_strings(e)]) for q, e in zip(queries, ends, strict=True)]))
            else:
                extend(set().union(*ends))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, body = av
            inner: list = []
            once = _walk(body, {""}, inner)
            if not inner and (least, most) == (0, 1):
                extend({"", *once})
            elif not inner and least == most and len(once) == 1:
                extend({next(iter(once)) * least})
            else:
                flush()
                if least:
                    found.append(_join("and", [*inner, _of_strings(once)]))
        elif op is sre.AT:
            continue
        else:
            flush()
    return current


def trigram_query(pattern: str, flags: int = 0):
    """Boolean trigram query, over lower-cased ASCII, that holds for every text with a match; True if there is none."""
    found: list = []
    rest = _walk(sre_parse.parse(pattern, flags), {""}, found)
    return _join("and", [*found, _of_strings(rest)])


def trigrams_of(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


def candidates(query, postings: dict[str, set[int]], every: set[int]) -> set[int]:
    """Rows of a segment for which ``query`` holds, by set operations on postings."""
    if query is True:
        return every
    if isinstance(query, str):
        return postings.get(query, set())
    parts = sorted((candidates(q, postings, every) for q in query[1]), key=len)
    return set.intersection(*parts) if query[0] == "and" else set.union(*parts)


def build_postings(texts: list[str], trigrams: set[str]) -> dict[str, set[int]]:
    """Postings of ``trigrams`` over the rows of a segment, lower-cased."""
    postings: dict[str, set[int]] = {t: set() for t in trigrams}
    for k, text in enumerate(texts):
        low = text.lower()
        for t in trigrams:
            if t in low:
                postings[t].add(k)
    return postings


def matcher(rule: tuple[str, str, int, int, int]) -> Callable[[str], list[tuple[int, int]]]:
    _, pattern, flags, group, least = rule
    if pattern == "[0-9a-f]+":  # the same runs, without stopping at each short one
        pattern = f"[0-9a-f]{{{least},}}"
    find = re.compile(pattern, flags).finditer
    return lambda text: [m.span() for m in find(text) if m.end(group) - m.start(group) >= least]


def scan_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end>>``, one row per row of ``docs``.

    Spans are in code points, end exclusive, by start and then in the order of
    the rules. A null text is empty and has no spans; rows that repeat get the
    same spans each; a text of any length is searched whole, as one row; extra
    columns are not read, whatever their names; an empty table gives no rows.
    """
    order = [r[0] for r in rules]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        queries = [trigram_query(p, f) for _, p, f, _, _ in rules]
        needed = set().union(*map(trigrams_of, queries))
        verify = [matcher(r) for r in rules]
        for b in batches:
            texts, every = b["text"], set(range(len(b["text"])))
            postings = build_postings(texts, needed)
            spans: list[list] = [[] for _ in texts]
            for k, query in enumerate(queries):
                for i in candidates(query, postings, every):
                    spans[i] += [(s, k, e) for s, e in verify[k](texts[i])]
            yield {"doc_id": b["doc_id"], "spans": [[{"kind": order[k], "start": s, "end": e} for s, k, e in sorted(x)] for x in spans]}

    return arrow_map(docs.select("doc_id", text_or_empty().alias("text")), run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin([r[0] for r in RULES[:BASE]]))
    return out.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )


def _sql_pattern(pattern: str, flags: int) -> str:
    """The pattern for an engine whose case folding knows more letters than ASCII: both cases, letter by letter."""
    if not flags & re.I:
        return pattern
    out, i, bracket = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            width = 4 if pattern[i + 1] == "x" else 2
            out, i = out + pattern[i : i + width], i + width
            continue
        bracket = c == "[" or bracket and c != "]"
        out += f"[{c.upper()}{c.lower()}]" if c.isalpha() and not bracket else c
        i += 1
    return out


def oracle(rules=RULES) -> str:
    """SQL of ``op3_secret_scan``: all matches of each rule, placed by what stands between them."""
    parts = []
    for k, (kind, pattern, flags, group, least) in enumerate(rules):
        p = _sql_pattern(pattern, flags).replace("'", "''")
        parts.append(
            f"SELECT doc_id, row, {k} AS k, '{kind}' AS kind, unnest(regexp_split_to_array(t, '{p}')[:-2]) AS gap, unnest(regexp_extract_all(t, '{p}')) AS found, "
            f"unnest(regexp_extract_all(t, '{p}', {group})) AS part, {least} AS least, unnest(range(len(regexp_extract_all(t, '{p}')))) AS nth FROM d"
        )
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT *, sum(len(gap) + len(found)) OVER (PARTITION BY row, k ORDER BY nth) AS e FROM m),
s AS (SELECT row, k, kind, (e - len(found))::BIGINT AS b, e::BIGINT AS e FROM p WHERE len(part) >= least),
g AS (SELECT row, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) FILTER (k < {BASE}) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) AS spans FROM s GROUP BY row)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)
"""
