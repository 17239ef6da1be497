"""Each operator against a brute-force version, an exact round trip or held-out labels, with the edge cases of each."""

from __future__ import annotations

import collections
import hashlib
import html as html_lib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, decontam, html_extract, media, mixing, near_dedup, quality, records, secrets, suffix_dedup

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "one two three four five six"), (4, "x" * 3000), (5, "é \t\n ü"), (6, "\x00\x01 a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def edge(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns named like results."""
    return spark.createDataFrame([(d, t, "en", None if d == 2 else "s", 0, "x", 1) for d, t in EDGE], "doc_id long, text string, lang string, source string, n_chars long, size string, copies long")


# --- secrets


def brute_spans(text):
    assign = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    return [
        [m.span() for m in assign.finditer(text) if len(m[1]) >= 12],
        [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18],
        [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16],
    ]


def test_secrets(spark, docs):
    extra = ["api_key = 'abcdefghijkl'", "APIKEY:abcdefghijklm password=short secret: \"QQQQWWWWEEEERRRR\"", "AKIA" + "A1" * 9 + " deadbeefdeadbeef00", "paſſword=abcdefghijklmno toKen=abcdefghijklmnop", None, "", "tokentoken=abcdefghijkl" * 3]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(both).collect()}
    for r in both.collect():
        base = brute_spans(r["text"] or "")
        for kind, spans in zip(("assign", "access", "hex"), base, strict=True):
            assert [(s["start"], s["end"]) for s in got[r["doc_id"]] if s["kind"] == kind] == spans
    assert secrets.scan_secrets(docs.limit(0)).count() == 0 and secrets.scan_secrets(edge(spark)).count() == len(EDGE)


def test_secret_query_digest(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in secrets.op3_secret_scan(spark, str(tmp_path)).collect()}
    for r in docs.collect():
        base = brute_spans(r["text"] or "")
        listed = sorted((s, k, e) for k, spans in enumerate(base) for s, e in spans)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in listed)
        o = out[r["doc_id"]]
        assert o["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and (o["n_assign"], o["n_access"], o["n_hex"]) == tuple(map(len, base))


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("AKIA[A-Z0-9]+", re.A) == ("and", ("aki", "kia"))
    q = secrets.trigram_query(secrets.RULES[0][1], re.I | re.A)
    rng = random.Random(3)
    for k, p, flags, _, _ in secrets.RULES:  # every match holds its query
        query, rx = secrets.trigram_query(p, flags), re.compile(p, flags)
        for _ in range(200):
            s = "".join(rng.choice("pasworde=tkn:AKI0f-BEGIN PRVTEY_ghlivx.@/") for _ in range(40)) + rng.choice(["password=abcd", "API_KEY: x1", "AKIAXYZ", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----"])
            if rx.search(s):
                assert secrets.candidates(query, secrets.build_postings([s], secrets.trigrams_of(query)), {0}) == {0}, (k, s)
    assert "pas" in secrets.trigrams_of(q) and "key" in secrets.trigrams_of(q)


# --- suffix arrays


def test_two_stage_sort():
    rng = random.Random(1)
    for _ in range(300):
        raw = bytes(rng.choice(b"ab\x00\xffc"[: rng.randint(1, 5)]) for _ in range(rng.randint(1, 200)))
        wanted = np.array([rng.random() < 0.7 for _ in raw])
        whole = raw + b"\x00\xff"
        assert [whole[i:] for i in suffix_dedup.two_stage_sort(raw, wanted, 400)] == sorted(whole[i:] for i in np.flatnonzero(wanted))


def brute_repeats(texts, length=200):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group_rows", [20_000, 3])
def test_suffix_dedup(spark, docs, group_rows):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdef ") for _ in range(333))
    own = [passage + "x", "y" + passage, passage[:199], passage[:200] + "é", "z" * 1000, "ab" * 300, "ab" * 150, "", None, "once " * 20]
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(60).collect()] + [(1000 + i, t) for i, t in enumerate(own)]
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group_rows).collect()}
    for (d, _), e in zip(rows, brute_repeats([(t or "").encode() for _, t in rows]), strict=True):
        assert got[d] == e


def test_suffix_dedup_large_groups(spark):
    """A passage between varying neighbours, split twice, against brute force; equal letters and copies in numbers."""
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdef ") for _ in range(260))
    near = lambda: "".join(rng.choice("xy") for _ in range(rng.randint(0, 40)))
    rows = [(k, near() + passage[: rng.randint(190, 260)] + near()) for k in range(120)] + [(500 + k, "u" * (400 + k) + passage) for k in range(3)]
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    for (d, _), e in zip(rows, brute_repeats([t.encode() for _, t in rows]), strict=True):
        assert got[d] == e
    rows = [(1, "a" * 5_000_000), (2, "b" + passage), (3, "c" * 199 + "d")]
    rows += [(4, (passage + "-") * 20_000)] + [(10 + k, passage) for k in range(3_000)]
    got = {r["doc_id"]: tuple(r)[1:4] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got[1] == (5_000_000, 5_000_000, 1) and got[2] == (261, 260, 1) and got[3] == (200, 0, 0)
    assert got[4] == (261 * 20_000, 261 * 20_000 - 0, 1) and {got[10 + k] for k in range(3_000)} == {(260, 260, 1)}


def test_anchor_pieces(monkeypatch):
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (5000, 10, 400, 0, 1999)] + [b"ab" * 1500, b"q" * 3000]

    def windows():
        found = set()
        for text, start, n, times, h in suffix_dedup.runs_of(texts):
            for t, s, k, m, x in zip(text, start, n, times, h, strict=True):
                found |= {(int(t), int(s) + w, int(x)) for w in range(int(k) * int(m))}
        return found

    whole = windows()
    assert {(t, s) for t, s, _ in whole} == {(t, s) for t, x in enumerate(texts) for s in range(len(x) - 199)}
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert windows() == whole


def test_suffix_dedup_edges(spark):
    out = suffix_dedup.remove_repeats(edge(spark)).collect()
    assert len(out) == len(EDGE) and {r["n_removed"] for r in out if r["doc_id"] == 4} == {3000}
    twice = spark.createDataFrame([(1, "q" + "abc" * 100)] * 2, "doc_id long, text string")
    assert [r["n_removed"] for r in suffix_dedup.remove_repeats(twice).collect()] == [301, 301]
    assert suffix_dedup.remove_repeats(edge(spark).limit(0)).count() == 0


# --- token records


def test_records_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(records.default_tokenizer())
    odd = [(9001, "<|endoftext|>ab It's, a_. x9. \x0b\x0c\xa0 日本 é É ſ ΑΣ"), (9002, None), (9003, ""), (9004, "a" * 5000), (9005, "İstanbul. ... ?!, end.\n\nNew")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    index = records.token_records(both, path=str(tmp_path / "rec"))
    rows = sorted(index.collect(), key=lambda r: r["doc_id"])
    texts = {r["doc_id"]: r["text"] or "" for r in both.collect()}
    start = 0
    for r in rows:
        ids = [*tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["n_tokens"], r["start"], r["ids_crc32"]) == (len(ids), start, zlib.crc32(np.array(ids, "<u4").tobytes())), r["doc_id"]
        start += len(ids)
    some = index.where("doc_id % 3 = 0")
    got = {r["doc_id"]: r["ids"] for r in records.read_records(some).collect()}
    assert got[9003] == [2] and len(got) == some.count()


def test_records_over_several_files(spark, tmp_path, monkeypatch):
    """Files of two records: starts follow the order of the files, and only listed files are opened."""
    monkeypatch.setattr(records, "FILE_RECORDS", 2)
    docs = spark.createDataFrame([(k // 3 if k < 9 else k, f"text {k} " * (k + 1)) for k in range(25)], "doc_id long, text string")
    records.write_records(docs, str(tmp_path / "few"), records.default_tokenizer(), shards=2)
    index = records.with_starts(records.scan_records(spark, str(tmp_path / "few"))).cache()
    rows = sorted(index.collect(), key=lambda r: r["start"])
    assert len({r["file"] for r in rows}) >= 12 and [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    some = spark.createDataFrame([(r["doc_id"], r["file"], r["offset"]) for r in rows if r["file"] == rows[5]["file"]], "doc_id long, file string, offset long")
    for name in {r["file"] for r in rows} - {rows[5]["file"]}:
        (tmp_path / "few" / name.rsplit("/", 1)[1]).unlink()
    assert sorted(r["doc_id"] for r in records.read_records(some).collect()) == sorted(r["doc_id"] for r in some.collect())


def test_record_damage():
    good = records.frame(records.pack(7, b"\1\0\2\0", True))
    payload, end = records.unframe(good, 0)
    assert records.unpack(payload)[0] == 7 and records.unpack(payload)[1].tolist() == [1, 2] and end == len(good)
    for k in range(len(good) - 1):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad), 0)


def test_record_edges(spark):
    assert records.token_records(edge(spark)).count() == len(EDGE)
    assert records.token_records(edge(spark).limit(0)).count() == 0


# --- HTML


def test_html(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html_lib.unescape(re.sub("<[^>]+>", "", b.replace("<br>", "\n")))).strip() for b in re.split("</?(?:p|h1)>", article)]
        text = "\n\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (text, len(text))


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<body><nav>m</nav><p>a<p>b &lt;c&gt;<footer>f</footer>", "a\n\nb <c>"),
    ("<body><header>h</header><main><h1>T</h1><div class='ad-box'>ad</div><div class=\"comments\">c</div><form>x</form><p>one\n two<br>three</p><aside>s</aside></main></body>", "T\n\none two three"),
    ("<article><script>a<b</script><style>p{}</style><p>x<!-- <p>no --></p><div id=cookie-notice>z</div></article>", "x"), ("<p", ""), ("<p>a<article>", ""),
])
def test_html_cases(page, text):
    assert html_extract.main_text(page, None) == text


@pytest.mark.parametrize(("page", "text"), [
    ("<body class='has-sidebar'><article><p>x</p></article></body>", "x"), ("<body class='no-sidebar post-comments-open'><p>x</p></body>", "x"),
    ("<div class='page search'><article><p>x</p><div class=share>s</div></article></div>", "x"), ("<body><div class='page search'><p>x</p></div></body>", "x"),
    ("<div class='wrap comments-open'><main>x</main></div><div class=related><article>r</article></div>", "x"), ("<div class=related><article>r</article></div><article>x</article>", "x"),
    ("<article><p>x</p><svg width=1 /><p>y</p></article>", "x\n\ny"), ("<article><p>x</p><button>go<p>y</p><select><object></article>", "x\n\ngo\n\ny"),
    ("<article><svg><text>no</text></svg><p>x</p><script>a<b</article>", "x"), ("<body class=menu><nav>m</nav><p>x</p></body>", "x"),
])
def test_html_wrappers(page, text):
    assert html_extract.main_text(page, None) == text


def test_html_edges(spark):
    rows = [(1, None, None), (1, "http://a.b/c", "<p>x"), (None, "http://a.b/d", ""), (2, "http://a.b/c", "<p>x")]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(r["text"] for r in out.collect()) == ["", "", "x", "x"]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_without_telling_tags(spark):
    notice = "We keep a record of what you read here so that we can show you more of the same tomorrow"
    words = [f"w{i}" for i in range(400)]
    page = lambda k: f"<body><div id=c1>Home News Contact</div><div id=c2><h1>About {words[k]}</h1><p>{' '.join(words[20 * k : 20 * k + 15])}</p><div id=c3>{notice}</div><p>{words[k]} again</p></div><div id=c4>All rights reserved</div></body>"
    want = lambda k: f"About {words[k]}\n\n{' '.join(words[20 * k : 20 * k + 15])}\n\n{words[k]} again"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(12)]
    rows += [(100 + k, f"http://b.example/{k}", page(3)) for k in range(4)]  # copies of a page: nothing varies
    rows += [(200 + k, f"http://c.example/{k}", page(k).replace("<div id=c2>", "<article>").replace("again</p></div>", "again</p></article>")) for k in range(5)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {d: got[d] for d in got if d < 100} == {k: want(k) for k in range(12)}
    assert all(want(3).split("\n\n")[1] in got[100 + k] for k in range(4))
    assert [got[200 + k] for k in range(5)] == [want(k) for k in range(5)]


def unnamed_page(k, title_outside=False):
    """A page whose tags and classes say nothing, and its article: menu, notice, comments and footer have no names."""
    rng = random.Random(k)
    words = lambda n: " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9))) for _ in range(n))
    title, paras = words(5), [words(rng.randint(8, 60)) for _ in range(rng.randint(2, 6))]
    menu = "".join(f"<b><a href='/{k}/{i}'>{words(2)}</a></b>" for i in range(5))
    notes = "".join(f"<div class=x9><b>{words(1)} says</b><i>{words(6)}</i></div>" for _ in range(1 + k % 4))
    inner = "".join(f"<p>{p} <span class='side'>effects</span> of <b class='alert'>caution</b>.</p>" if i == 0 else f"<p>{p}</p>" for i, p in enumerate(paras))
    notice = "<div class=x3>We keep a record of what you read here so that we can show you more of the same tomorrow</div>"
    head = f"<h1>{title}</h1>"
    page = f"<html><body><div class=x1>{menu}</div><div id=lead>Home Shop</div>{head if title_outside else ''}<div class=x2>{'' if title_outside else head}{notice}{inner}{notes}</div><div class=x4>All rights reserved by {words(1)}</div></body></html>"
    return page, "\n\n".join([title, f"{paras[0]} effects of caution.", *paras[1:]])


@pytest.mark.parametrize("outside", [False, True])
def test_html_by_slots(spark, outside):
    made = {k: unnamed_page(k, outside) for k in range(30)}
    rows = [(k if k % 3 else None, f"http://h.example/{k}", p) for k, (p, _) in made.items()]
    rows += [rows[4]] * 2 + [(None, "http://h.example/copy", made[7][0])] * 25  # rows that repeat, and most pages copies of one
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    for r in out:
        k = 7 if r["url"].endswith("copy") else int(r["url"].rsplit("/", 1)[1])
        assert (r["text"], r["n_chars"]) == (made[k][1], len(made[k][1]))
        assert html_extract.main_text(made[k][0]) != made[k][1]  # without the template


def test_html_records_by_tags():
    """Comments without a constant word: records of three elements behind the article."""
    rng = random.Random(2)
    words = lambda n: " ".join(str(rng.random())[2:9] for _ in range(n))
    pages, want = [], []
    for k in range(8):
        paras = [words(20) for _ in range(2 + k % 3)]
        sections = "".join(f"<section><h2>{p[:7]}</h2><p>{p}</p></section>" for p in paras)
        notes = "".join(f"<div class=u><b>{words(1)}</b><i>{words(5)}</i></div>" for _ in range(1 + k % 2))
        pages.append(f"<body><div class=v><p>{words(9)} {k}</p>{sections}{notes}</div></body>")
        want.append("\n\n".join([re.search("<p>(.*?)</p>", pages[-1])[1], *(t for p in paras for t in (p[:7], p))]))
    memo = {}
    docs = [html_extract.Page(p, memo) for p in pages]
    rows = collections.defaultdict(list)
    for k, d in enumerate(docs):
        for t, va, vb, most, kind, chars, links in zip(*html_extract.page_vector(d, k * 7919 + 1, memo), strict=True):
            rows[int(t)].append((int(va), int(vb), int(most), int(kind), int(chars), int(links)))
    cls = {t: (sum(r[0] for r in v), sum(r[1] for r in v), len(v)) for t, v in rows.items() if len(v) >= 5}
    size = collections.Counter(cls.values())
    packed = [(np.uint64(t).view(np.int64), hash(c) >> 4, max(r[2] for r in rows[t]), rows[t][0][3], sum(r[4] for r in rows[t]) / c[2], sum(r[5] for r in rows[t]) / c[2]) for t, c in cls.items() if size[c] >= 3]
    template = html_extract.Template(np.array(packed, html_extract._ROW).tobytes())
    assert [html_extract.main_text(p, template) for p in pages] == want


# --- near duplicates


def brute_components(texts, percent=85):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in texts.items():
        w = WORDS.findall(t.translate(lower))
        sets[d] = frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in texts}


def test_near_duplicates(spark, texts):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    more = dict(texts)
    for k in range(60):  # a family whose members link to the base or to few of each other
        w = list(base)
        for _ in range(k % 7):
            w[rng.randrange(120)] = f"v{rng.random()}"
        more[5000 + k] = " ".join(w)
    more |= {6000: "Same few Words", 6001: "same FEW words", 6002: "", 6003: "a b c d e", 6004: "A B\tC D\nE"}
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(list(more.items()), "doc_id long, text string")).collect()}
    for d, (n, c) in brute_components(more).items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (n, c, d == c)


def test_near_duplicates_edges(spark):
    out = near_dedup.near_duplicates(edge(spark)).collect()
    assert len(out) == len(EDGE) and all(r["component_id"] == r["doc_id"] for r in out)
    assert near_dedup.near_duplicates(edge(spark).limit(0)).count() == 0
    assert near_dedup.keep_one(edge(spark)).columns == edge(spark).columns


def test_pigeonhole():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.integers(0, 65536, near_dedup.SYMBOLS).astype("<u2")
        b = a.copy()
        at = rng.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)
        b[at] ^= 1
        ka, kb = near_dedup.chunk_keys(np.stack([a, b]))
        assert (ka == kb).any()


# --- mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in capped]
        total = sum(w[s] for s in free)
        for s in free:
            target[s] = left * w[s] / total
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = most * sizes[s]
            capped.add(s)
            left -= target[s]


@pytest.mark.parametrize("case", ["data", "skewed"])
def test_mixing(spark, docs, case):
    if case == "skewed":
        rows = [(i, "w " * (50 if i < 400 else 1), "big" if i < 400 else f"s{i % 9}" if i % 5 else None) for i in range(500)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.copies(docs).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert [len(WORDS.findall(t or "")) for (t,) in docs.orderBy("doc_id").select("text").collect()] == [r["size"] for r in sorted(out, key=lambda r: r["doc_id"])]
    sizes = collections.Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
    expected = brute_targets(sizes)
    for r in out:
        assert r["target"] == pytest.approx(expected[r["source"]]) and r["source_size"] == sizes[r["source"]]
        rate = expected[r["source"]] / sizes[r["source"]]
        assert int(rate - 1e-9) <= r["copies"] <= min(3, int(rate + 1e-9) + 1)
    assert mixing.mix(docs).count() == sum(r["copies"] for r in out)
    again = mixing.copies(docs.repartition(3)).select("doc_id", "copies")
    assert sorted(map(tuple, again.collect())) == sorted((r["doc_id"], r["copies"]) for r in out)


def test_mixing_edges(spark):
    assert mixing.copies(edge(spark)).count() == len(EDGE) and mixing.mix(edge(spark)).columns == edge(spark).columns
    assert mixing.copies(edge(spark).limit(0)).count() == 0
    odd = spark.createDataFrame([(i, "a b", "s", "mine", 7) for i in range(20)], "doc_id long, text string, source string, size string, rate long")
    assert {(r["size"], r["rate"]) for r in mixing.mix(odd).collect()} == {("mine", 7)}
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [r["copies"] for r in mixing.copies(nothing).collect()] == [0, 0]


# --- chat


def test_chat_round_trip(spark):
    rng = random.Random(4)
    pieces = [*chat.CONTROL, "\\", "/", "a", "\n", "é", "<", "[", ">"]
    for _ in range(500):
        s = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(s)) == s and not any(c in chat.escape(s) for c in chat.CONTROL)
    turns = [(1, 1, "assistant", "</s> ok \\"), (1, 0, "user", "[INST]<|end|>"), (1, None, None, None), (2, 0, "assistant", ""), (None, 0, "assistant", "n"), (None, 0, "assistant", "n")]
    f = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.parse_conversations(f).collect()}
    text = "\n\nuser\n[INST]<|end|>\nassistant\n</s> ok \\\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[1]["n_turns"] == 3
    assert got[1]["loss_sha256"] == hashlib.sha256("</s> ok \\".encode()).hexdigest() and got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 2
    assert got[1]["formatted_chars"] == sum(len(r["segment"]) for r in f.collect() if r["conv_id"] == 1)
    assert chat.parse_conversations(f.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = '[{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 1024, "height": 600}, {"type": "audio", "ref": "b", "seconds": 1.2}, {"type": "document", "ref": "c", "pages": 3}, {"type": "odd", "x": 1}]'
    row = chat.format_conversations(spark.createDataFrame([(1, 0, "user", parts)], "conv_id long, turn long, role string, parts string"), "parts").head()
    assert [a["kind"] for a in row["attachments"]] == ["image", "audio", "document"] and row["expanded_tokens"] == 256 * 4 + 25 * 2 + 512 * 3
    for a in row["attachments"]:
        assert row["segment"][a["position"] :].startswith(chat.PLACEHOLDERS[a["kind"]])
    assert row["loss_start"] == row["loss_end"] and '"odd"' in chat.unescape(row["segment"])


# --- media


def test_telephony_tables():
    mu, a = media.mulaw_table(), media.alaw_table()
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80]) == (0, 0, -32124, 32124) and (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def scalar_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for nib in (n for b in block[4:] for n in (b & 15, b >> 4)):
        step = int(media.STEPS[index])
        diff = (step >> 3) + (step >> 2) * (nib & 1) + (step >> 1) * (nib >> 1 & 1) + step * (nib >> 2 & 1)
        value = max(-32768, min(32767, value - diff if nib & 8 else value + diff))
        index = max(0, min(88, index + int(media.INDEX_CHANGE[nib])))
        out.append(value)
    return out


def test_adpcm_and_resampling():
    rng = random.Random(9)
    data = bytes(rng.randrange(256) for _ in range(64 * 5 + 20))
    blocks = [data[k : k + 64] for k in range(0, len(data), 64)]
    assert media.decode_adpcm(data, 64).tolist() == [v for b in blocks for v in scalar_adpcm(b)]
    assert media.decode_adpcm(b"", 64).size == 0
    x = np.array([0, 100, -100], np.int16)
    assert media.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100] and media.resample(x, 8000, 8000).tolist() == x.tolist()
    assert media.resample(x[:0], 8000, 16000).size == 0


def test_resampling_in_pieces():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = rng.integers(-32768, 32768, rng.integers(0, 60)).astype(np.int16)
        cut = np.sort(rng.integers(0, len(x) + 1, rng.integers(0, 5)))
        hz = [int(v) for v in rng.choice([8000, 11025, 16000, 6000, 48000], 2)]
        got = list(media.resample_pieces(iter(np.split(x, cut)), *hz))
        assert np.concatenate([np.zeros(0, np.int16), *got]).tolist() == media.resample(x, *hz).tolist()


def test_media_features(monkeypatch, spark):
    """Stored form and feature against whole arrays, with pieces far shorter than the text."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc \u00e9\u4e00") for _ in range(n)) for n in (0, 1, 5000, 777)]
    whole = {}
    for k, t in enumerate(texts):
        raw = t.encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        x = media.resample(media.mulaw_table()[np.frombuffer(payload, np.uint8)], 8000, 16000).astype(int)
        feature = f"n={len(x)};rms={int(np.sqrt((x * x).sum() // len(x)))};peak={abs(x).max()};zc={((x[1:] < 0) != (x[:-1] < 0)).sum()};pcm={zlib.crc32(x.astype('<i2').tobytes()):08x}"
        head = b"RIFF" + (4 + 26 + 12 + 8 + len(payload)).to_bytes(4, "little") + b"WAVEfmt \x12\0\0\0" + bytes([7, 0, 1, 0]) + (8000).to_bytes(4, "little") * 2 + bytes([1, 0, 8, 0, 0, 0]) + b"fact\4\0\0\0" + len(payload).to_bytes(4, "little") + b"data" + len(payload).to_bytes(4, "little")
        whole[k] = (len(head) + len(payload), hashlib.sha256(head + payload).hexdigest(), feature)
    monkeypatch.setattr(media, "PIECE", 100)
    assert [media.feature(t.encode().ljust(max(1, -(-len(t.encode()) // 192)) * 192), 7, 8000) for t in texts] == [whole[k][2] for k in whole]
    got = media.read_media(media.store_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert {r["doc_id"]: (r["media_bytes"], r["media_sha256"], r["feature"]) for r in got} == whole


def test_media_round_trip(spark, docs):
    both = docs.select("doc_id", "text").unionByName(edge(spark).select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    got = media.read_media(media.store_media(both)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for d, t in both.collect():
        raw = (t or "").encode()
        padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        for r in by[d]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    pcm = media.decode_media(media.store_media(both.limit(3))).head()
    assert pcm["pcm_hz"] == 16000 and len(pcm["pcm"]) == 4 * (len(pcm["media"]) - len(media.wave(b"")))
    assert media.read_media(media.store_media(both.limit(0))).count() == 0


# --- quality and benchmark


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.classify(docs, labels.where("doc_id % 2 = 0"))
    held = out.join(labels.where("doc_id % 2 = 1"), "doc_id").select((F.col("keep") == (F.col("quality") == 1)).alias("ok")).collect()
    assert np.mean([r["ok"] for r in held]) >= 0.95
    assert out.count() == docs.count()


def brute_posteriors(rows, site_weight=quality.SITE_WEIGHT):
    """``(host_posterior, path_posterior, p_quality)`` by loops over ``doc_id, host, path, p_doc``: moments, shrinkage, leave-one-out."""
    logit = lambda p: np.log(p / (1 - p))
    by = {n: collections.defaultdict(list) for n in (1, 2)}
    for r in rows:
        by[1][r["host"],].append(r["p_doc"])
        by[2][r["host"], r["path"]].append(r["p_doc"])
    mean = np.mean([r["p_doc"] for r in rows])

    def strength(groups, prior):
        some = {k: np.array(g) for k, g in groups.items() if len(g) > 1}
        n = sum(map(len, some.values()))
        if not some or n <= len(some):
            return 10.0
        within = max(sum(((g - g.mean()) ** 2).sum() for g in some.values()) / (n - len(some)), 1e-9)
        between = max(sum(len(g) * (g.mean() - prior(k)) ** 2 for k, g in some.items()) / n - within * len(some) / n, 1e-9)
        return min(1000.0, max(1.0, within / between))

    kh = strength(by[1], lambda k: mean)
    post = {k: (sum(g) + kh * mean) / (len(g) + kh) for k, g in by[1].items()}
    kp = strength(by[2], lambda k: post[k[:1]])
    out = []
    for r in rows:
        h, p = by[1][r["host"],], by[2][r["host"], r["path"]]
        host = (sum(h) - r["p_doc"] + kh * mean) / (len(h) - 1 + kh)
        path = (sum(p) - r["p_doc"] + kp * host) / (len(p) - 1 + kp)
        odds = logit(r["p_doc"]) + site_weight * (logit(np.clip(path, 1e-3, 1 - 1e-3)) - logit(np.clip(mean, 1e-3, 1 - 1e-3)))
        out.append((post[r["host"],], path, 1 / (1 + np.exp(-odds))))
    return out


@pytest.mark.parametrize("case", ["data", "sparse"])
def test_posteriors_against_brute_force(spark, docs, case):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    if case == "sparse":  # a large host, hosts of one document, nulls
        site = F.when(F.col("doc_id") % 3 == 0, "big").when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("h"), (F.col("doc_id") / 2).cast("int").cast("string")))
        docs = docs.withColumn("source", site)
    rows = quality.classify(docs, labels).collect()
    for r, (host, path, p) in zip(rows, brute_posteriors(rows), strict=True):
        assert (r["host_posterior"], r["path_posterior"], r["p_quality"]) == pytest.approx((host, path, p), rel=1e-9) and r["keep"] == (r["p_quality"] >= 0.5)


def test_training_rows_do_not_depend_on_order(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int")
    docs = spark.createDataFrame([(k % 6, "word " * (k + 1)) for k in range(60)], "doc_id long, text string")
    one, two = quality.training_rows(docs.repartition(3), labels), quality.training_rows(docs.orderBy(F.desc("text")), labels)
    assert len(one[1]) == 6 and (one[0] == two[0]).all() and (one[1] == two[1]).all()


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(edge(spark), labels).count() == len(EDGE)
    assert quality.classify(edge(spark), labels.limit(0)).count() == len(EDGE)
    assert quality.classify(edge(spark).limit(0), labels).count() == 0
    assert quality.keep_good(edge(spark), labels).columns == edge(spark).columns
    ends = [features_ok(t) for t in ("", "a", "\n\n", "é" * 10, "x" * 10_000)]
    assert all(ends)


def features_ok(text):
    x = quality.features(text)
    return len(x) == quality.N_FEATURES and np.isfinite(x).all()


def test_leaks(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    words = lambda s: re.findall(r"\w+", s.lower())
    seen = collections.defaultdict(set)
    for i, t in items.items():
        w = words(t)
        for k in range(len(w) - 7):
            seen[tuple(w[k : k + 8])].add((i, k))
    count = collections.Counter()
    for d, t in texts.items():
        w = words(t)
        for k in range(len(w) - 7):
            for i, j in seen.get(tuple(w[k : k + 8]), ()):
                count[d, i, k - j] += 1
    assert got == {(d, i) for (d, i, _), n in count.items() if n >= min(6, len(words(items[i])) - 7)}


def test_reworded_questions(spark):
    tail = " of rope while the old farmer counts every wooden fence post near the river bank and later Anna sells it"
    item = "The shop of Tom has 12 apples and gives Anna 5 km" + tail
    docs = {
        1: "Once. " + item, 2: "Once. " + item.replace("Tom", "Bob").replace("Anna", "Lena").replace("12", "7").replace(" 5 km", " 9 miles"),
        3: "Once. " + item.replace("gives Anna", "gives Lena"), 4: "Nothing of the kind " * 5, 5: None,
    }
    got = {r["doc_id"]: r for r in decontam.find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(1, item), (2, "too short")], "item_id long, text string")).collect()}
    assert set(got) == {1, 2}  # in 3 one name stands for two
    assert got[1]["n_changed"] == 0 and got[2]["n_changed"] == 6


def test_short_and_dense_items(spark):
    items = {
        1: "What is the capital of France?", 2: "Solve for x: 3x + 7 = 22.", 3: "What is 3 + 4 * 5 - 6 / 2?",
        4: "Add 12 15 18 21 24 27 30 33 to 36 now.", 5: "Find the median of the prices Anna paid for her lunch.",
    }
    docs = {10 * k: f"Some words before, then Q {t} And some words after it." for k, t in items.items()}
    docs |= {1: "What is the capital of Spain? France is near.", 3: "So what is 3 - 4 * 5 + 6 / 2?", 4: items[4].replace("36", "37"), 5: "What is the capital of", 6: None, 7: ""}
    frame = lambda rows, names: spark.createDataFrame(list(rows.items()), names)
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect())
    assert got == [(10 * k, k) for k in items]


def test_reworded_to_equal_values(spark):
    item = "The old farmer has 3 apples and 5 pears in a basket under the tree and sells them all before the evening"
    docs = {1: "Once. " + item.replace("3", "4").replace("5", "4"), 2: "Once. " + item.replace("3", "7")}
    got = {r["doc_id"]: r["n_changed"] for r in decontam.find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: 2, 2: 1}


def leaks(spark, docs, items):
    rows = lambda x, key: spark.createDataFrame(list(x.items()), f"{key} long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontam.find_leaks(rows(docs, "doc_id"), rows(items, "item_id")).collect()}


def test_names_values_and_units(spark):
    items = {
        1: "Tom has 12 apples. Anna buys 3 pears. How many pieces of fruit do Tom and Anna have together after lunch?",
        2: "A rope of 1.5 metres is cut in 4 parts of the same length by a sailor on the old ship.",
        3: "Mary Smith walks 5 km to the market with her dog and 7 km back home every single day of the week.",
        4: "compute 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24",
    }
    docs = {
        1: "Bob has 7 apples. Lena buys 2 pears. How many pieces of fruit do Bob and Lena have together after lunch?",
        2: items[2].replace("1.5", "15"), 3: items[3].replace("Mary Smith", "Joan").replace("5 km", "5km").replace("7 km", "8km"),
        4: f"So {items[4]} now.", 5: items[4].replace("13", "31"), 6: items[1], 7: "Some Words. " + items[3], 8: "Question " + items[1],
    }
    got = leaks(spark, docs, items)
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (6, 1), (7, 3), (8, 1)}
    assert {k: got[k]["n_changed"] for k in got} == {(1, 1): 6, (2, 2): 1, (3, 3): 2, (4, 4): 0, (6, 1): 0, (7, 3): 0, (8, 1): 0}


def test_verbatim_with_one_value_changed(spark):
    item = "Tom keeps 12 hens. " + " ".join(f"{a}{b}" for a in ("farm", "field", "river", "stone", "tree", "road") for b in ("side", "hand", "yard", "ward", "fall")) + " and so does Tom."
    assert set(leaks(spark, {1: item.replace("does Tom", "does Bob"), 2: item.replace("Tom keeps", "Ann keeps").replace("fieldhand", "x").replace("stonehand", "y")}, {1: item})) == {(1, 1)}


def brute_template(text):
    """Template tokens and values by a scan of words, without regular expressions on the whole."""
    toks, values = [], []
    for w in re.findall(r"[^\W\d_]+|\d+(?:[.,:/]\d+)*", text):
        if w[0].isdigit():
            toks.append("#d")
        elif toks and toks[-1] == "#d" and w.lower() in decontam.UNITS:
            toks.append("#u")
        elif w[0].isupper() and w[1:].islower() and w not in decontam.OPENERS:
            toks.append("#n")
        else:
            toks.append(w.lower())
            values.append(None)
            continue
        values.append(w.lower())
    return toks, values


def brute_leaks(docs, items):
    """Hits, changed slots and verbatim windows of each diagonal, for items that have template windows (3 at least, or all)."""
    sought, index, out = {}, collections.defaultdict(list), {}
    for i, item in items.items():
        s, sv = brute_template(item)
        windows = [p for p in range(len(s) - 7) if sum(x[0] == "#" for x in s[p : p + 8]) <= 4]
        if windows and (len(windows) >= 3 or len(windows) == len(s) - 7):
            sought[i] = (s, sv, windows)
            for p in windows:
                index[tuple(s[p : p + 8])].append((i, p))
    for d, text in docs.items():
        t, tv = brute_template(text)
        diagonals = collections.defaultdict(list)
        for pos in range(len(t) - 7):
            for i, p in index.get(tuple(t[pos : pos + 8]), ()):
                diagonals[i, pos - p].append(p)
        for (i, shift), at in diagonals.items():
            s, sv, windows = sought[i]
            if len(at) < min(6, len(windows)):
                continue
            covered = sorted({p + k for p in at for k in range(8) if sv[p + k] is not None})
            changed = {k for k in covered if sv[k] != tv[k + shift]}
            stands = collections.defaultdict(set)
            for k in covered:
                stands[s[k], sv[k]].add(tv[k + shift])
            same = sum(not changed & set(range(p, p + 8)) for p in at)
            if max(map(len, stands.values()), default=0) <= 1 or not changed or same >= 0.75 * len(windows):
                out[d, i] = max(out.get((d, i), (0, 0)), (len(at), -len(changed)))
    return out


def test_leaks_against_brute_force(spark):
    """Random questions, re-parameterised in their names, numbers and units, some inconsistently; recall over the consistent ones is 1."""
    rng = random.Random(8)
    names, units = ["Tom", "Anna", "Bob", "Lena", "Otto", "Ida"], ["km", "kg", "miles", "hours"]
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8)))
    items, docs, sound = {}, {}, set()
    for i in range(40):
        n = [rng.choice(names) for _ in range(2)]
        v = [f"{rng.randint(1, 99)}.{rng.randint(1, 9)}" if rng.random() < 0.3 else str(rng.randint(1, 99)) for _ in range(2)]
        parts = [x for _ in range(5) for x in (" ".join(word() for _ in range(rng.randint(2, 6))), rng.choice([n[0], n[1], v[0], v[1], f"{v[0]} {units[i % 4]}"]))]
        parts = [f"{n[0]} has {v[0]} {units[i % 4]} of"] + parts + [word(), "at last?"]
        items[i] = ". ".join(" ".join(parts[k : k + 3]) for k in range(0, len(parts), 3))
        for k in range(4):
            text = items[i]
            if k:
                put = dict(zip([*names, *v, *units], [*rng.sample(names, len(names)), str(rng.randint(100, 900)), f"{rng.randint(100, 900)}.5", *rng.sample(units, len(units))], strict=True))
                cut = re.split(r"(\d+(?:\.\d+)?|\b(?:" + "|".join([*names, *units]) + r")\b)", text)
                text = "".join(put.get(x, x) for x in cut)
                if k == 2:  # one mention differs
                    at = [m.span() for m in re.finditer("|".join(names), text)]
                    a, b = at[-1]
                    text = text[:a] + "Zoe" + text[b:]
            if k < 2:
                sound.add((10 * i + k, i))
            docs[10 * i + k] = " ".join(word() for _ in range(rng.randint(0, 20))) + ". " + text + " " + word()
    got = leaks(spark, docs, items)
    expected = brute_leaks(docs, items)
    assert {k: (r["n_hits"], -r["n_changed"]) for k, r in got.items()} == expected and sound <= set(got)


def test_long_runs_of_names_and_numbers(spark):
    """A run is one slot whatever its length, and takes no stack."""
    item = "Tom has 12 apples and the old farmer counts every wooden fence post near the river bank"
    docs = {1: " ".join(["Alpha"] * 100_000) + ". so " + item, 2: ".".join(["7"] * 100_000) + " so " + item.replace("12", "13"), 3: ",".join(["7"] * 100_000) + " " + "Alpha  " * 100_000}
    assert {k: r["n_changed"] for k, r in leaks(spark, docs, {1: item}).items()} == {(1, 1): 0, (2, 1): 1}


def test_leak_edges(spark):
    items = spark.createDataFrame([(1, None), (None, "a b c d e f g h i j"), (2, "")], "item_id long, text string")
    assert decontam.find_leaks(edge(spark), items).count() == 0
    assert decontam.drop_leaks(edge(spark), items).count() == len(EDGE)
    assert decontam.find_leaks(edge(spark).limit(0), items).count() == 0


# --- all operators on odd tables


def clashing(spark):
    """Rows of ``EDGE`` with an extra column of each name that a result or an inner step uses."""
    names = "row kept runs spans host path template component_id node key h c media pcm payload start shard file label size copies rate target item_id pos digest p".split()
    df = edge(spark).select("doc_id", "text", "lang", "source", "n_chars")
    return df.select("*", *(F.lit("clash").alias(n) for n in names))


def test_clashing_columns(spark):
    docs = clashing(spark)
    items = spark.createDataFrame([(1, "one two three four five six", "x", "y")], "item_id long, text string, doc_id string, h string")
    labels = spark.createDataFrame([(1, 1, 0, "x"), (3, 0, 0, "y")], "doc_id long, quality int, toxic int, text string")
    plain = edge(spark)
    for of in (secrets.scan_secrets, suffix_dedup.remove_repeats, near_dedup.near_duplicates, media.store_media, lambda d: records.token_records(d).select("doc_id", "start", "n_tokens"), lambda d: quality.classify(d, labels), lambda d: decontam.find_leaks(d, items)):
        assert sorted(map(repr, of(docs).collect())) == sorted(map(repr, of(plain).collect()))
    for of in (near_dedup.keep_one, mixing.mix, lambda d: quality.keep_good(d, labels), lambda d: decontam.drop_leaks(d, items)):
        assert of(docs).columns == docs.columns and {r["h"] for r in of(docs).collect()} <= {"clash"}
    pages = spark.createDataFrame([(1, "http://a/b", "<p>x", "1", "2")], "page_id long, url string, html string, host string, template string")
    assert [r["text"] for r in html_extract.extract(pages).collect()] == ["x"]
    turns = spark.createDataFrame([(1, 0, "user", "a", "x", 1)], "conv_id long, turn long, role string, text string, segment string, seq long")
    assert chat.parse_conversations(chat.format_conversations(turns)).count() == 1


def test_very_long_text(spark):
    """A text of 12 MB through every operator."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(2_000_000))
    item = "Tom has 12 apples and the old farmer counts every wooden fence post near the river bank"
    rows = [(1, long + " password=abcdefghijklmnop " + item, "s", "en"), (2, item, "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(2)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    n = len(rows[0][1])
    assert {r["doc_id"]: len(r["spans"]) for r in secrets.scan_secrets(docs).collect()}[1] >= 1
    assert {r["doc_id"]: r["n_bytes"] for r in suffix_dedup.remove_repeats(docs).drop("kept").collect()}[1] == n
    assert {r["doc_id"]: r["n_tokens"] > 0 for r in records.token_records(docs).collect()} == {1: True, 2: True}
    assert {r["doc_id"]: r["kept"] for r in near_dedup.near_duplicates(docs).collect()} == {1: True, 2: True}
    assert {r["doc_id"]: r["payload_bytes"] for r in media.read_media(media.store_media(docs)).collect()}[1] == -(-n // 192) * 192
    assert {(r["doc_id"], r["n_changed"]) for r in decontam.find_leaks(docs, spark.createDataFrame([(7, item.replace("Tom", "Ann").replace("12", "3"))], "item_id long, text string")).collect()} == {(1, 2), (2, 2)}
    assert quality.classify(docs, labels).count() == 2 and mixing.copies(docs).count() == 2
    page = f"<body><div>{'<p>' + long[: 2_000_000] + '</p>'}</div></body>"
    assert html_extract.extract(spark.createDataFrame([(1, "http://a/b", page)], "page_id long, url string, html string")).head()["n_chars"] == len(long[:2_000_000].strip())
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert chat.parse_conversations(chat.format_conversations(turns)).head()["n_turns"] == 2
