"""MinHash near-duplicate links by a multi-index Hamming join.

Each distinct set of word shingles gets a signature of ``SYMBOLS`` minhash
values cut to ``BITS`` bits. Two signatures that differ in at most ``DISTANCE``
symbols must, by pigeonhole, differ in at most one symbol in one of the
``CHUNKS`` chunks; so every chunk is indexed once for each symbol that may be
wrong, with that symbol left out, and all pairs within the distance meet under
some key. Candidates within the distance are confirmed on the full sets.

A key's group is never paired with itself as a whole. A first round links each
member to the key's best connected member (most company over all its keys: the
hub of a family of copies). Keys whose members then share one component need
nothing more. Of those that stay open, small ones compare their members of
different components; members of large ones are narrowed to pairs whose rarest
shared shingles allow a link at all (an exact prefix filter), again between
different components only. So no link between components is lost, and no group
is expanded into all pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize, release, small_side, table, text_or_empty

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 85
SYMBOLS, BITS, CHUNKS = 64, 16, 12
#: Most symbols that a pair may differ in: one error a chunk is always found.
DISTANCE = 2 * CHUNKS - 1
#: Keys of at most so many members compare all their components at once.
SMALL_KEY = 8

_U = np.uint64
_RNG = np.random.default_rng(20240917)
_odd = lambda n: _RNG.integers(0, 2**64, n, dtype=np.uint64) | _U(1)
_BYTE = _odd(256)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = _odd(SHINGLE)
_XOR, _MUL = _odd(SYMBOLS), _odd(SYMBOLS)
_BASE = int(_odd(1)[0]) | 5
_KEY_PLACE, _KEY_MASK = _odd(SYMBOLS), _odd(SYMBOLS)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _miss(chunks: int, percent: int) -> float:
    """Probability that a pair at the threshold differs in more symbols than ``chunks`` chunks find."""
    p = 1 - percent / 100
    return sum(math.comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k) for k in range(2 * chunks, SYMBOLS + 1))


@functools.lru_cache
def chunks_for(percent: int) -> int:
    """The fewest chunks that miss a pair at ``percent`` no more often than ``CHUNKS`` one at ``PERCENT``."""
    if percent == PERCENT:
        return CHUNKS
    enough = [c for c in range(1, SYMBOLS // 2 + 1) if _miss(c, percent) <= _miss(CHUNKS, PERCENT)]
    if not enough:
        raise ValueError(f"signatures of {SYMBOLS} symbols are too short for a threshold of {percent} %")
    return enough[0]


class _Powers:
    """Powers of an odd base mod 2**64 and of its inverse, as far as asked for."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 1 << 16)
            inverse = pow(_BASE, -1, 2**64)
            cls.up = np.cumprod(np.r_[_U(1), np.full(n - 1, _BASE, np.uint64)])
            cls.down = np.cumprod(np.r_[_U(1), np.full(n - 1, inverse, np.uint64)])
        return cls.up, cls.down


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``raw`` starts, and its hash."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = ~_SPACE[raw]
    edge = np.diff(np.r_[False, word, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _Powers.upto(len(raw))
    total = np.r_[_U(0), np.cumsum(_BYTE[raw] * up[: len(raw)])]
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; texts go through in runs of about a megabyte."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        run, size = [], 0
        while k < len(texts) and (not run or size < 1_000_000):
            run.append(texts[k].encode())
            size += len(run[-1]) + 1
            k += 1
        start, words = word_hashes(np.frombuffer(b" ".join(run), np.uint8))
        first = np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in run)]))
        if len(words) >= SHINGLE:
            n = len(words) - SHINGLE + 1
            grams = mix(sum(words[i : i + n] * _PLACE[i] for i in range(SHINGLE)))
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(grams[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + _U(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(grams: np.ndarray) -> np.ndarray:
    low = np.full(SYMBOLS, 2**64 - 1, np.uint64)
    for k in range(0, len(grams), 2048):
        np.minimum(low, ((grams[k : k + 2048, None] ^ _XOR) * _MUL).min(0), out=low)
    return (mix(low) >> _U(64 - BITS)).astype("<u2")


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_key, sig`` of each row; equal sets have equal keys."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            sets = shingle_sets(b["text"])
            yield {
                "doc_id": b["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "set_key": [np.array([np.bitwise_xor.reduce(s), mix(s + _U(1)).sum(dtype=np.uint64), len(s)], np.uint64).tobytes() if len(s) else None for s in sets],
                "sig": [signature(s).tobytes() if len(s) else None for s in sets],
            }

    return arrow_map(docs.select("doc_id", text_or_empty().alias("text")), run, "doc_id long, n_shingles long, set_key binary, sig binary")


def chunk_keys(sigs: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """One key for each row of ``sigs`` and each symbol that may be wrong: the other symbols of its chunk."""
    h = mix(sigs.astype(np.uint64) * _KEY_PLACE + _KEY_PLACE)
    chunk_at = np.array([k * SYMBOLS // chunks for k in range(chunks)])
    chunk = np.searchsorted(chunk_at, np.arange(SYMBOLS), side="right") - 1
    return mix((np.add.reduceat(h, chunk_at, axis=1)[:, chunk] - h) ^ _KEY_MASK)


def index_keys(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``key, node``: the multi-index, ``SYMBOLS`` rows a node."""
    chunks = chunks_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, SYMBOLS)
                node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(chunk_keys(sigs, chunks).ravel().view(np.int64)), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def within_distance(pairs: DataFrame, sigs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose signatures differ in as many symbols at most as the chunks find."""
    distance = 2 * chunks_for(percent) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, SYMBOLS) for k in (2, 3))
            yield b.filter(pa.array((x != y).sum(1) <= distance)).select(["a", "b"])

    both = pairs.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) that link on their full sets. A hub's text is not carried through a shuffle once a pair."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        kept: dict[int, np.ndarray] = {}
        for b in batches:
            fresh = {a: t for a, t in zip(b["a"], b["ta"], strict=True) if a not in kept}
            if len(kept) > 200:
                fresh, kept = {**{a: t for a, t in zip(b["a"], b["ta"], strict=True)}}, {}
            kept.update(zip(fresh, shingle_sets(list(fresh.values())), strict=True))
            out: dict[str, list] = {"a": [], "b": []}
            for x, y, other in zip(b["a"], b["b"], shingle_sets(b["tb"]), strict=True):
                own = kept[x]
                same = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * same >= percent * (len(own) + len(other) - same):
                    out["a"].append(x)
                    out["b"].append(y)
            yield out

    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return arrow_map(both.select("a", "b", "ta", "tb"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node in ``links`` (a, b): the least node it is connected with.

    Large-star and small-star steps in turn until the edges stay as they are;
    a node's neighbours are reduced to their minimum with partial aggregation
    and joined back, never gathered.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")

    def star(both: DataFrame, keep: str) -> DataFrame:
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where(keep).join(low, "u")

    before = None
    while True:
        state = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).head()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, "v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(star(both, "v < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = materialize(nxt, "cc")
        release(edges)
        edges = nxt


def _shingle_rows(texts: DataFrame) -> DataFrame:
    """``node, s, size``: the shingles of each text."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for node, grams in zip(b["node"], shingle_sets(b["text"]), strict=True):
                yield {"node": np.full(len(grams), node), "s": grams.view(np.int64), "size": np.full(len(grams), len(grams))}

    return arrow_map(texts.select("node", "text"), run, "node long, s long, size long")


def prefix_pairs(labelled: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of ``labelled`` (node, label) that can link and have different labels.

    Sets that overlap enough share a shingle near the front of both, with
    shingles from rare to frequent: by their places there, at most
    ``min(size - place)`` can be common. Members of a shingle's most frequent
    label are met by those of other labels only.
    """
    rows = materialize(_shingle_rows(texts.join(labelled.select("node"), "node", "left_semi")), "near-shingles")
    known = materialize(rows.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "near-frequent")
    order = Window.partitionBy("node").orderBy("df", "s")
    placed = rows.join(known, "s", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("place", F.row_number().over(order) - 1)
    front = placed.where(F.col("df") > 1).where(100 * (F.col("size") - F.col("place")) >= percent * F.col("size"))
    front = materialize(front.join(labelled, "node").select("s", "node", "label", "size", "place"), "near-front")
    most = front.groupBy("s", "label").agg(F.count("*").alias("k")).groupBy("s").agg(F.max(F.struct("k", "label")).alias("m"), F.count("*").alias("labels"))
    # stored, so that the joins are of two shuffles each and a frequent shingle's rows are split
    most = materialize(most.where("labels > 1").select("s", F.col("m.label").alias("most")), "near-most")
    x = materialize(front.join(most, "s").where("label <> most").select(*front.columns), "near-minor").alias("x")
    y = front.alias("y")
    total = F.col("x.size") + F.col("y.size")
    able = (100 + percent) * F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) >= percent * total
    near = 100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size")
    pairs = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.label") != F.col("y.label")) & able & near)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_links(nodes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """Links (a, b) whose components are those of all links between ``nodes``; None if no key is shared.

    ``nodes`` has ``node, sig`` (distinct sets), ``docs`` ``doc_id, text`` of at
    least these nodes.
    """
    keys = index_keys(nodes, percent)
    counts = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-counts")
    shared = materialize(keys.join(counts, "key"), "near-keys")
    company = materialize(shared.groupBy("node").agg(F.sum("n").alias("company")), "near-company")
    n_nodes = company.count()
    if not n_nodes:
        return None
    sigs = materialize(nodes.select("node", "sig").join(small_side(company.select("node"), n_nodes), "node", "left_semi"), "near-sigs")
    mine = small_side(company.select(F.col("node").alias("doc_id")), n_nodes)
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(mine, "doc_id", "left_semi")
    # rows that repeat a doc_id would repeat its pairs: one text a node
    texts = materialize(texts.select(F.col("doc_id").alias("node"), "text").dropDuplicates(["node", "text"]), "near-texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        close = materialize(within_distance(pairs.distinct(), sigs, percent), "near-close")
        return materialize(confirm(close, texts, percent), "near-links")

    hubs = shared.join(company, "node").groupBy("key").agg(F.max(F.struct("company", -F.col("node"))).alias("best")).select("key", (-F.col("best.col2")).alias("hub"))
    links = confirmed(shared.join(hubs, "key").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")))

    labels = materialize(components(links), "near-labels")
    labelled = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    open_keys = materialize(labelled.join(mixed, "key", "left_semi"), "near-open")
    small = open_keys.where(F.col("n") <= SMALL_KEY)
    few = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")))
    few = few.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    large = materialize(open_keys.where(F.col("n") > SMALL_KEY).select("node", "label").distinct(), "near-large")
    pairs = few if large.isEmpty() else few.unionByName(prefix_pairs(large, texts, percent))
    return links.unionByName(confirmed(pairs))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    A null text is empty; an empty set links with nothing. Equal sets are one
    node, named by its least doc_id. Rows without doc_id link with nothing and
    are kept, with a null component; rows that repeat a doc_id get the same
    result and stand or fall together; texts of any length are read whole;
    extra columns are not read, whatever their names. An empty table gives no
    rows.
    """
    rows = materialize(sketches(docs), "near-sketches")
    known = rows.where("set_key is not null and doc_id is not null")
    nodes = materialize(known.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")), "near-nodes")
    links = near_links(nodes, docs, percent)
    classes = nodes.select("set_key", "node")
    if links is not None:
        classes = classes.join(components(links), "node", "left").select("set_key", F.coalesce("label", "node").alias("component"))
    else:
        classes = classes.withColumnRenamed("node", "component")
    # The least doc_id of a component is a node: each node is the least of its class.
    out = known.select("doc_id", "n_shingles", "set_key").join(classes, "set_key")
    alone = rows.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    out = out.select("doc_id", "n_shingles", "component").unionByName(alone)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, columns as given."""
    gone = materialize(near_duplicates(docs, percent).where("not kept").select("doc_id").distinct(), "near-gone")
    left = docs.join(small_side(gone, gone.count()), "doc_id", "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All links of the table by an inverted index of the shingles, without signatures; components by labels that spread.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
n AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n FROM g),
r AS MATERIALIZED (SELECT doc_id, unnest(s) AS s FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS meet FROM r a JOIN r b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * meet >= 85 * (x.n + y.n - meet)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS label FROM n UNION SELECT e.a, reach.label FROM reach JOIN e ON e.b = reach.doc_id),
m AS (SELECT doc_id, min(label) AS component_id FROM reach GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m USING (doc_id)
"""
