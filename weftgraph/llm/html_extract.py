"""Main text of web pages by equivalence-class template deduction.

Tokens are tags, words of short texts and long texts as a whole, each with the
path it stands in. Tokens with the same occurrence vector over the distinct
pages of a host (how often in which page) form an equivalence class; large
classes that most pages hold are valid. The class whose tokens stand once in a
page is the template's root; classes that repeat within a page nest in its
slots as records. What stands between the template's tokens is its slots: a
text made of template tokens alone is constant, any other fills a slot, and a
block goes if all its texts are constant.

The region is what the root class leaves open: from the root of the page
downward, the root-class element that holds most of its parent's slot text over
the whole host, down to the one whose own paragraphs are slots. In it, records
with constant words (or, behind the last other slot, records of several
elements) are reader comments and the like, and root-class elements whose text
is links are menus. A text cannot tell an advert that changes with each page
from the article, so there, and on hosts with too few pages for a template,
elements that HTML or their class, id or role sets apart are left out.

Vectors are never gathered: a token carries sums of hashes of (page, count),
which partial aggregation combines, so a host of any size costs one row a
token and task. Words of a text over ``LABEL_WORDS`` words are no tokens of
their own: a text goes only if all of it is constant, and that a long one shows
as a whole.
"""

from __future__ import annotations

import collections
import functools
import html as html_lib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, small_side, table

#: A class is the template's if it has so many tokens, in so many pages and so large a share of them.
MIN_TOKENS, MIN_PAGES, MIN_SHARE = 3, 3, 0.6

#: Words of a text up to which they count as tokens; a longer one is a token as a whole.
LABEL_WORDS = 12

#: Share of an element's slot text, over the host, with which a part of it becomes the region.
REGION_SHARE = 0.6
#: Share of links in the text of a root-class element that makes it a menu.
LINK_SHARE = 0.8
#: Elements in one record of which constant words are not needed.
RECORD_ELEMENTS = 3
#: Hosts whose templates a worker keeps.
KEPT_TEMPLATES = 2000

#: Fixed values of HTML: elements without content, with raw text, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "select", "button")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An element that is closed when one of the same group opens beside it.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
P_ENDS = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dt", "dd", "legend", "summary"}

#: Elements that a region can be, that can be menus, and that can be records by their tags alone.
REGIONS = frozenset("html body div section article main center table tbody tr td".split())
MENUS = frozenset("div section ul ol dl table header".split())
RECORDS = frozenset("div section article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements and words in class, id or role that serve other ends than the article. Words count on blocks only.
APART = frozenset("nav footer aside form menu dialog".split())
APART_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|cookies?|consent|notice|banner|alert|comments?|replies|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|popup|modal|overlay|footer|masthead|complementary|contentinfo|toolbar|pagination|pager|login|search|widget)(?:$|[\s_-])"
)
#: A class that only tells the state of the element ("has-sidebar", "comments-open") sets nothing apart.
STATE = re.compile(r"(?:has|no|not|with|without|is|hide|show|enable|disable)[_-].*|.*[_-](?:open|opened|closed|enabled|disabled|active|inactive|on|off|visible|hidden)")
#: Where an article stands, best first: elements, then words in class, id or role.
MAIN_TAGS = ("article", "main")
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|articlebody|main|post|entry|story|content|body-text|bodytext)(?:$|[\s_-])")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
#: Unclosed, these have no text, but code up to the end of the page.
_CODE = ("script", "style")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name or text, marks)``: open, close, text. marks: class, id and role of the element, lower case.

    A raw element that closes itself or is never closed is empty.
    """
    at: int | None = 0
    unclosed: set[str] = set()
    while at is not None:
        start, at = at, None
        for m in _TOKEN.finditer(page, start):
            if m["text"] is not None:
                yield "text", m["text"], ""
            elif m["raw"]:
                raw = m["raw"].lower()
                yield "raw", raw, ""
                if m[0].endswith("/>") or raw in unclosed:
                    continue
                if end := _END[raw].search(page, m.end()):
                    at = end.end()
                    break
                if raw in _CODE:
                    return
                unclosed.add(raw)
            elif name := (m["name"] or m["name2"]):
                if m["close"] or m["close2"]:
                    yield "close", name.lower(), ""
                else:
                    attrs = m["attrs"] or m["attrs2"] or ""
                    yield "open", name.lower(), " ".join(a or b or c for _, a, b, c in _ATTR.findall(attrs)).lower() if "=" in attrs else ""

_U = np.uint64
_ROOT_KEY = 0x51ED270B9F2D1B85
_OPEN, _CLOSE, _TEXT = 1, 2, 0


def _hash(s: str) -> int:
    b = s.encode("utf-8", "surrogatepass")
    return zlib.crc32(b) | zlib.crc32(b, 0x9E3779B9) << 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Page:
    """A page as a repaired tree: implied ends are put in, stray ends left out.

    ``steps`` are ``(kind, text or name, node)`` in page order; nodes are
    numbered as they open, 0 is the root, and ``key`` hashes a node's path.
    """

    def __init__(self, page: str, memo: dict) -> None:
        self.steps: list[tuple[int, str, int]] = []
        self.parent, self.token, self.name, self.key = [0], [""], [""], [_ROOT_KEY]
        stack, names = [0], [""]
        steps = self.steps

        def add(x: str, marks: str) -> int:
            token = f"{x}.{'.'.join(sorted(marks.split()))}" if marks else x
            up = stack[-1]
            at = (self.key[up], token)
            key = memo.get(at)
            if key is None:
                if len(memo) > 300_000:
                    memo.clear()
                key = memo[at] = _hash(f"{self.key[up]:x}/{token}")
            self.parent.append(up)
            self.token.append(token)
            self.name.append(x)
            self.key.append(key)
            steps.append((_OPEN, x, len(self.key) - 1))
            return len(self.key) - 1

        for kind, x, marks in events(page):
            if kind == "text":
                steps.append((_TEXT, x, stack[-1]))
            elif kind == "close":
                if x in names:
                    k = len(names) - 1 - names[::-1].index(x)
                    steps.append((_CLOSE, x, stack[k]))
                    del stack[k:], names[k:]
                elif x == "br" or x == "p":
                    add(x, "")
            elif kind == "open":
                if x in P_ENDS and "p" in names:
                    k = len(names) - 1 - names[::-1].index("p")
                    del stack[k:], names[k:]
                for k in range(len(names) - 1, 0, -1):
                    if names[k] in CLOSES.get(x, ()):
                        del stack[k:], names[k:]
                        break
                    if names[k] in ("ul", "ol", "dl", "table", "div", "section", "article"):
                        break
                node = add(x, marks)
                if x not in VOID:
                    stack.append(node)
                    names.append(x)

    def below(self, flag: list[bool]) -> list[bool]:
        """For each node: whether it or one above it is flagged."""
        out = flag[:]
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parent[k]]
        return out

    def sums(self, own: list[int]) -> list[int]:
        """Sums of ``own`` over the nodes' subtrees."""
        out = own[:]
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out


def text_words(text: str) -> list[str]:
    """What counts as tokens of a text: its words, or a long one as a whole."""
    words = text.split(None, LABEL_WORDS)
    return words if len(words) <= LABEL_WORDS else [text.strip()]


def in_path(ids: list[int], keys: list[int]) -> np.ndarray:
    """Hashes of tokens at the nodes with these keys."""
    return _mix(np.array(ids, _U) ^ np.array(keys, _U) * _U(0x9E3779B97F4A7C15))


_TAG = {_OPEN: _hash("<"), _CLOSE: _hash("</")}


def text_tokens(doc: Page, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts in order, and the number of tokens of each text."""
    ids: list[int] = []
    keys: list[int] = []
    sizes: list[int] = []
    for kind, x, node in doc.steps:
        if kind == _TEXT:
            words = text_words(x)
            for w in words:
                h = memo.get(w) if len(w) <= 100 else _hash(w)
                if h is None:
                    if len(memo) > 300_000:
                        memo.clear()
                    h = memo[w] = _hash(w)
                ids.append(h)
            keys += [doc.key[node]] * len(words)
            sizes.append(len(words))
    return in_path(ids, keys), np.array(sizes, np.int64)


def tag_tokens(doc: Page, kind: int = _OPEN) -> np.ndarray:
    """Hashes of the nodes' opening tags (the root's, too) or, in page order, of the closing ones."""
    keys = doc.key if kind == _OPEN else [doc.key[n] for k, _, n in doc.steps if k == _CLOSE]
    return in_path([_TAG[kind]] * len(keys), keys)


def text_sizes(doc: Page) -> tuple[list[int], list[int]]:
    """Characters of each node's own texts, outside of links and in them."""
    linked = doc.below([n == "a" for n in doc.name])
    plain, links = [0] * len(doc.key), [0] * len(doc.key)
    for kind, x, node in doc.steps:
        if kind == _TEXT:
            (links if linked[node] else plain)[node] += len(x.strip())
    return plain, links


#: ``va`` and ``vb`` are the vector: sums of 31-bit hashes, so copies of a page never cancel and sums do not overflow.
VECTORS = "host string, token long, va long, vb long, pages long, most long, kind int, chars long, links long"


def page_vector(doc: Page, page_key: int, memo: dict) -> tuple[np.ndarray, ...]:
    """The columns of ``VECTORS`` for one page, without host and pages."""
    words, _ = text_tokens(doc, memo)
    opens, closes = tag_tokens(doc)[1:], tag_tokens(doc, _CLOSE)
    every = np.concatenate([words, opens, closes])
    kinds = np.repeat(np.array([_TEXT, _OPEN, _CLOSE], np.int32), [len(words), len(opens), len(closes)])
    ids, first, counts = np.unique(every, return_index=True, return_counts=True)
    vec = _mix(_mix(counts.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(1)) ^ _U(page_key))
    at = np.searchsorted(ids, opens)
    sizes = [np.zeros(len(ids), np.int64) for _ in range(2)]
    for out, own in zip(sizes, text_sizes(doc), strict=True):
        np.add.at(out, at, np.array(doc.sums(own)[1:], np.int64))
    return ids, (vec & _U(0x7FFFFFFF)).astype(np.int64), (vec >> _U(33)).astype(np.int64), counts, kinds[first], *sizes


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """Per host and token: the vector, pages that hold it, its largest count in one, its kind, and text below it if it opens an element."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        memo: dict = {}
        for b in batches:
            by_host: dict[str, list] = {}
            for host, digest, page in zip(b["host"], b["digest"], b["html"], strict=True):
                by_host.setdefault(host, []).append(page_vector(Page(page, memo), digest & 0xFFFFFFFFFFFFFFFF, memo))
            for host, parts in by_host.items():
                ids, va, vb, most, kind, chars, links = (np.concatenate(x) for x in zip(*parts, strict=True))
                if not len(ids):
                    continue
                order = np.argsort(ids, kind="stable")
                ids, va, vb, most, kind, chars, links = (x[order] for x in (ids, va, vb, most, kind, chars, links))
                at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                yield {
                    "host": [host] * len(at), "token": ids[at].view(np.int64), "va": np.add.reduceat(va, at), "vb": np.add.reduceat(vb, at), "pages": np.diff(np.r_[at, len(ids)]),
                    "most": np.maximum.reduceat(most, at), "kind": kind[at], "chars": np.add.reduceat(chars, at), "links": np.add.reduceat(links, at),
                }

    part = arrow_map(pages.select("host", "digest", "html"), run, VECTORS)
    total = [F.sum(c).alias(c) for c in ("va", "vb", "pages", "chars", "links")]
    return part.groupBy("host", "token").agg(*total, F.max("most").alias("most"), F.max("kind").alias("kind"))


_ROW = np.dtype([("token", "<i8"), ("cls", "<i8"), ("most", "<i8"), ("kind", "<i4"), ("chars", "<f8"), ("links", "<f8")])


def distinct_pages(base: DataFrame) -> DataFrame:
    """Rows of ``base`` (with ``host`` and ``digest``), one of those with the same host and html.

    Of copies, the one with the least id and URL; rows that are equal in all
    stay, which weighs all tokens of the page alike. Copies are listed, not
    gathered: the list is broadcast if it is short.
    """
    copies = base.groupBy("host", "digest").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "url")).alias("first")).where("n > 1").select("host", "digest", "first")
    copies = materialize(copies, "template-copies")
    known = base.join(small_side(copies, copies.count()), ["host", "digest"], "left")
    return known.where(F.col("first").isNull() | F.struct("page_id", "url").eqNullSafe(F.col("first"))).drop("first")


def deduce_templates(pages: DataFrame) -> DataFrame:
    """One row a host with valid classes: ``host, template binary`` (rows of ``Template``).

    ``pages`` has ``host, digest, html``. Tokens that most pages of a host hold
    are no more than a page has, so a host's row is bounded by its pages' size.
    """
    per_host = pages.groupBy("host").agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= MIN_PAGES)
    hosts = materialize(per_host, "template-hosts")
    tokens = occurrence_vectors(pages).join(small_side(hosts, hosts.count()), "host")
    frequent = tokens.where((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= MIN_SHARE * F.col("host_pages")))
    frequent = materialize(frequent, "template-tokens")
    vector = ["host", "va", "vb", "pages"]
    valid = frequent.groupBy(*vector).agg(F.count("*").alias("size")).where(F.col("size") >= MIN_TOKENS)
    kept = frequent.join(valid, vector, "left_semi")
    row = F.struct("token", F.xxhash64("va", "vb", "pages").alias("cls"), "most", "kind", (F.col("chars") / F.col("pages")).alias("chars"), (F.col("links") / F.col("pages")).alias("links"))
    lists = kept.groupBy("host").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"host": b["host"], "template": [np.array([tuple(r[n] for n in _ROW.names) for r in rows], _ROW).tobytes() for rows in b["rows"]]}

    return arrow_map(lists, run, "host string, template binary")


class Template:
    """Valid classes of a host: tokens in order of their hash, with class, largest count in a page, kind and mean text below."""

    def __init__(self, data: bytes) -> None:
        rows = np.sort(np.frombuffer(data, _ROW), order="token")
        self.token, self.cls, self.most, self.chars, self.links = (rows[n] for n in ("token", "cls", "most", "chars", "links"))
        self.opens = rows["kind"] == _OPEN
        worded, spread = set(rows["cls"][rows["kind"] == _TEXT].tolist()), collections.Counter(rows["cls"][self.opens].tolist())
        nested = set(rows["cls"][self.most > 1].tolist())
        self.with_words = nested & worded & spread.keys()
        self.by_tags = {c for c in nested if spread[c] >= RECORD_ELEMENTS} - self.with_words

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """The row of each token; -1 for those that are not the template's."""
        t = tokens.view(np.int64)
        at = np.minimum(np.searchsorted(self.token, t), len(self.token) - 1)
        return np.where(self.token[at] == t, at, -1)


@functools.lru_cache(10_000)
def _is_apart(token: str, words: bool = True) -> bool:
    """Whether an element serves other ends by its name or, a block and with ``words``, by its class, id or role."""
    name, _, marks = token.partition(".")
    if name in APART:
        return True
    return words and name in BLOCK and name not in ("html", "body") and any(APART_WORDS.search(w) and not STATE.fullmatch(w) for w in marks.split("."))


@functools.lru_cache(10_000)
def _main_rank(token: str, words: bool = True) -> int:
    """0 is best; 9: no place for an article."""
    name, _, marks = token.partition(".")
    if _is_apart(token, words):
        return 9
    if name in MAIN_TAGS:
        return MAIN_TAGS.index(name)
    return 2 if name in BLOCK and MAIN_WORDS.search(marks.replace(".", " ")) else 3 if name == "body" else 9


class Slots:
    """What a template says of a page: constant texts, records, menus and the region."""

    def __init__(self, doc: Page, template: Template, memo: dict) -> None:
        words, sizes = text_tokens(doc, memo)
        hit = np.r_[template.places(words) >= 0, False]
        ends = np.cumsum(sizes)
        missed = np.r_[0, np.cumsum(~hit)]
        constant = (sizes > 0) & (missed[ends] == missed[ends - sizes])
        self.constant = constant.tolist()  # of each text in order
        row = template.places(tag_tokens(doc)[: len(doc.key)])
        row[0] = -1
        self.row, self.template, self.doc = row.tolist(), template, doc
        linked = doc.below([n == "a" for n in doc.name])
        own, self.filled = [0] * len(doc.key), [0] * len(doc.key)
        for (x, node), fixed in zip(((x, node) for kind, x, node in doc.steps if kind == _TEXT), self.constant, strict=True):
            if not linked[node] and not x.isspace():
                if fixed:
                    own[node] += len(x.strip())
                else:
                    self.filled[node] += 1
        self.fixed = doc.sums(own)

    def weight(self, node: int) -> float:
        """Mean slot text, outside of links, of the element over the host."""
        return max(0.0, float(self.template.chars[self.row[node]]) - self.fixed[node])

    def region(self) -> int:
        """The node that the root class leaves open for the article; 0 if none stands out."""
        doc, t = self.doc, self.template
        apart = doc.below([_is_apart(x, False) for x in doc.token])
        parts: dict[int, list[int]] = {}
        direct = [n > 0 for n in self.filled]
        for k in range(1, len(doc.key)):
            up = doc.parent[k]
            if self.row[k] >= 0 and t.most[self.row[k]] == 1 and doc.name[k] in REGIONS and not apart[k]:
                parts.setdefault(up, []).append(k)
        filled = doc.sums(self.filled)
        for k in range(1, len(doc.key)):
            up = doc.parent[k]
            if filled[k] and (doc.name[k] == "p" or doc.name[k] not in BLOCK and doc.name[k] not in ("a", "head", "title")):
                direct[up] = True
        main = [k for k in range(1, len(doc.key)) if doc.name[k] in MAIN_TAGS and self.row[k] >= 0 and t.most[self.row[k]] == 1 and not apart[k]]
        if main:
            return min(main, key=lambda k: (MAIN_TAGS.index(doc.name[k]), -self.weight(k), k))
        at = 0
        while at in parts and not direct[at]:
            best = max(parts[at], key=lambda k: (self.weight(k), -k))
            whole = self.weight(at) if at else sum(map(self.weight, parts[at]))
            if not whole or self.weight(best) < REGION_SHARE * whole:
                break
            at = best
        return 0 if doc.name[at] in ("", "html", "body") else at

    def menus(self, region: int) -> list[bool]:
        """Root-class elements whose text is links."""
        t = self.template
        out = [False] * len(self.doc.key)
        for k, row in enumerate(self.row):
            if row >= 0 and k != region and t.most[row] == 1 and self.doc.name[k] in MENUS and t.links[row] > 0:
                out[k] = bool(t.links[row] >= LINK_SHARE * (t.links[row] + t.chars[row]))
        return out

    def records(self, skip: list[bool], inside: list[bool]) -> list[bool]:
        """Elements of repeated classes that have constant words, or several elements, no heading and no other slot behind them."""
        doc, t = self.doc, self.template
        cls = [int(t.cls[r]) if r >= 0 else 0 for r in self.row]
        outer = [c != 0 and c != cls[doc.parent[k]] and doc.name[k] in BLOCK for k, c in enumerate(cls)]
        worded = [o and c in t.with_words and doc.name[k] not in ("tr", "td", "th", "p") for k, (o, c) in enumerate(zip(outer, cls, strict=True))]
        headed = doc.sums([n in HEADINGS for n in doc.name])
        tagged = [o and c in t.by_tags and doc.name[k] in RECORDS and not headed[k] for k, (o, c) in enumerate(zip(outer, cls, strict=True))]
        if any(tagged):
            in_tagged, gone = doc.below(tagged), doc.below(worded)
            texts = iter(self.constant)
            last = -1
            for k, (kind, x, node) in enumerate(doc.steps):
                if kind == _TEXT and not next(texts) and not x.isspace() and inside[node] and not (skip[node] or in_tagged[node] or gone[node]):
                    last = k
            for k, (kind, _, node) in enumerate(doc.steps):
                if kind == _OPEN and tagged[node] and k < last:
                    tagged[node] = False
            if last < 0:
                tagged = [False] * len(tagged)
        return [a or b for a, b in zip(worded, tagged, strict=True)]


def rule_region(doc: Page, words: bool) -> tuple[int, int, list[bool]]:
    """``(key, rank, apart)`` by the elements' own names and marks: of the best place for an article, and which nodes are set apart.

    Words in class, id or role set nothing apart that holds the only article.
    """
    n = len(doc.key)
    apart = doc.below([_is_apart(x) for x in doc.token])
    holder = [False] * n
    if not any(_main_rank(doc.token[k]) < 2 and not apart[doc.parent[k]] for k in range(1, n)):
        # the only articles stand below elements whose classes set them apart: these hold the page
        hard = doc.below([_is_apart(x, False) for x in doc.token])
        for k in range(1, n):
            if _main_rank(doc.token[k], False) < 2 and not hard[doc.parent[k]]:
                while k:
                    holder[k] = True
                    k = doc.parent[k]
    holders = {doc.key[k] for k in range(1, n) if holder[k]}
    own = [_is_apart(doc.token[k], words and doc.key[k] not in holders) for k in range(n)]
    apart = doc.below(own)
    ranked = [(_main_rank(doc.token[k], words and doc.key[k] not in holders), k) for k in range(1, n) if not apart[k]]
    rank, best = min(ranked, default=(9, 0))
    return (doc.key[best], rank, own) if rank < 9 else (doc.key[0], 9, own)


def main_text(page: str, template: Template | None = None, memo: dict | None = None, slots: bool = True, words: bool = True) -> str:
    """The article's blocks, joined by an empty line.

    With a template, the region is the one that its root class leaves open and
    the result is the blocks there that hold a slot; a page that the template
    does not fit, or whose host has none, is read by its own elements. Blocks
    of constant texts alone, records and menus stay only if the region holds nothing else: copies of one page
    have no slots. Words in class, id or role set nothing apart that holds the
    only article, or where they would leave no text.
    """
    memo = {} if memo is None else memo
    doc = Page(page, memo)
    filled = Slots(doc, template, memo) if template is not None else None
    region, rank, apart = rule_region(doc, words)
    node = filled.region() if filled else 0
    if node:
        region, rank = doc.key[node], 0
        up = node
        while up:  # what holds the region is not apart
            apart[up], up = False, doc.parent[up]
    inside = doc.below([k == region for k in doc.key])
    if rank in (3, 9):
        apart = [a or n in ("header", "head") for a, n in zip(apart, doc.name, strict=True)]
    # what stands at or above the region sets nothing in it apart
    skip = doc.below([a and inside[doc.parent[k]] and k > 0 for k, a in enumerate(apart)])
    if filled and slots:
        menus = filled.menus(node)
        gone = doc.below([m and inside[doc.parent[k]] for k, m in enumerate(menus)])
        gone = [a or b for a, b in zip(gone, doc.below(filled.records([a or b for a, b in zip(skip, gone, strict=True)], inside)), strict=True)]
        if node and not any(n == "h1" and i for n, i in zip(doc.name, inside, strict=True)):
            aside = doc.below(apart)
            titles = doc.below([n == "h1" and k < node and filled.row[k] >= 0 and not aside[k] for k, n in enumerate(doc.name)])
            inside = [a or b for a, b in zip(inside, titles, strict=True)]
    else:
        gone = [False] * len(doc.key)
    blocks: list[str] = []
    current: list[str] = []
    left_out = set_apart = open_slot = False
    constant = iter(filled.constant) if filled else itertools.repeat(False)

    def flush() -> None:
        nonlocal left_out, open_slot
        text = re.sub(r"\s+", " ", html_lib.unescape("".join(current))).strip()
        if text and open_slot:
            blocks.append(text)
        elif text:
            left_out = True
        current.clear()
        open_slot = False

    for kind, x, at in doc.steps:
        if kind == _TEXT:
            fixed = next(constant)
            if inside[at]:
                if skip[at]:
                    set_apart = set_apart or not x.isspace()
                elif gone[at]:
                    left_out = left_out or not x.isspace()
                    current.append(" ")
                else:
                    open_slot = open_slot or not (slots and fixed)
                    current.append(x)
        elif x in BLOCK:
            flush()
        elif x == "br" and inside[at]:
            current.append("\n")
    flush()
    if left_out and not blocks:
        return main_text(page, template, memo, False, words)
    if set_apart and words and not blocks:
        return main_text(page, template, memo, slots, False)
    return "\n\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``.

    Null html is empty and gives an empty text; null URLs share the host "";
    rows that repeat, or share an id or a null id, get a result each and count
    once for the template where host and html are equal; extra columns are not
    read, whatever their names; a page of any length is one tree in memory (about
    30 times its size); an empty table gives no rows.
    """
    host = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))
    base = pages.select("page_id", "url", F.lower(host).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = base.select("page_id", "url", "host", F.xxhash64("html").alias("digest"), "html")
    templates = materialize(deduce_templates(distinct_pages(keyed).select("host", "digest", "html")), "templates")
    n = templates.count()
    joined = base.join(small_side(templates, 20 * n), "host", "left").select("page_id", "url", "host", "html", "template")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        memo: dict = {}
        seen: dict[str, Template] = {}
        for b in batches:
            out = []
            for host, page, data in zip(b["host"], b["html"], b["template"], strict=True):
                own = None
                if data:
                    own = seen.get(host)
                    if own is None:
                        if len(seen) >= KEPT_TEMPLATES:
                            seen.clear()
                        own = seen[host] = Template(data)
                out.append(main_text(page, own, memo))
            yield {"page_id": b["page_id"], "url": b["url"], "text": out, "n_chars": [len(t) for t in out]}

    return arrow_map(joined, run, "page_id long, url string, text string, n_chars long")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
