"""Removal of byte passages that occur more than once, with suffix arrays.

Every window of ``LENGTH`` bytes picks an anchor: the least hash of its grams
of ``GRAM`` bytes, the leftmost among equals. Equal windows pick equal anchors,
so all windows that can be equal meet in the groups of anchors that occur at
least twice. A run of windows with one anchor travels as the bytes it covers,
its context. The contexts of a group are suffix-sorted in two stages: suffixes
smaller than their successors are sorted directly, the others are induced by a
scan of the buckets; adjacent common prefixes of ``LENGTH`` or more then show
which windows are equal.

A group too large for one sort is split by content, and its parts are sorted
likewise: first by the bytes that all windows share whose anchor lies in the
same band of ``BAND`` places, then, where that is not enough, by whole windows,
whose parts hold one distinct context each. Equal windows never part, so the
sizes that start a split decide nothing about results.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, release, small_side, table, text_or_empty

LENGTH = 200
GRAM = 72
#: Occurrences of an anchor up to which its contexts are sorted together.
GROUP_ROWS = 20_000
#: Places of an anchor in its window that the first split keeps together.
BAND = 16
#: Windows that are sorted at once, about.
SORT_WINDOWS = 60_000
#: Bytes whose anchors are found at once; longer texts go through in overlapping pieces.
PIECE = 2_000_000
#: Bytes of contexts that a worker holds to count equal ones.
HELD_BYTES = 16_000_000

_U = np.uint64
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | _U(1)
_BASE = int(_RNG.integers(0, 2**62)) * 4 + 1
_PLACE_BITS = 28


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 1 << 16)
            cls.up = np.cumprod(np.r_[_U(1), np.full(n - 1, _BASE, np.uint64)])
            cls.down = np.cumprod(np.r_[_U(1), np.full(n - 1, pow(_BASE, -1, 2**64), np.uint64)])
        return cls.up, cls.down


def gram_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each place on."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _Powers.upto(len(raw))
    total = np.r_[_U(0), np.cumsum(_BYTE[raw] * up[: len(raw)])]
    return _mix((total[length:] - total[:n]) * down[:n])


def anchor_runs(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, number of windows and anchor hash of each run in ``raw``; documents end at ``ends``.

    Windows lie within one document; those that follow each other with the
    same anchor are one run.
    """
    span = length - gram + 1
    n = len(raw) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    hashes = gram_hashes(raw, gram)
    low = (hashes >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (span - size)], low[span - size :])[:n]
    anchor = (low & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    start = np.arange(n)
    doc = np.searchsorted(ends, start, side="right")
    fits = start + length <= ends[np.minimum(doc, len(ends) - 1)]
    start, doc, anchor = start[fits], doc[fits], anchor[fits]
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])
    count = np.diff(np.r_[first, len(start)])
    begins = np.r_[0, ends[:-1]]
    return doc[first], start[first] - begins[doc[first]], count, hashes[anchor[first]]


def merge_periods(raw: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs to keep and how often each stands one behind the other with the same context, as in periodic text.

    ``at`` are the runs' places in ``raw``.
    """
    times = np.ones(len(at), np.int64)
    if len(at) < 2:
        return np.ones(len(at), bool), times
    like = (h[1:] == h[:-1]) & (n[1:] == n[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + n[:-1])
    for size in np.unique(n[:-1][like]):
        k = np.flatnonzero(like & (n[:-1] == size))
        differ = np.r_[0, np.cumsum(raw[:-size] != raw[size:])]
        like[k] = differ[at[k] + size + LENGTH - 1] == differ[at[k]]
    keep = np.r_[True, ~like]
    first = np.flatnonzero(keep)
    return keep, np.diff(np.r_[first, len(at)])


def runs_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``text, start, n, times, h`` of the anchor runs of ``texts``, some megabytes at once."""
    k = 0
    while k < len(texts):
        if len(texts[k]) > PIECE:  # windows that start in a piece, each piece with the bytes that the last of them covers
            pieces = [(k, at, texts[k][at : at + PIECE + LENGTH - 1]) for at in range(0, len(texts[k]) - LENGTH + 1, PIECE)]
            batches = [[x] for x in pieces]
            k += 1
        else:
            part, size = [], 0
            while k < len(texts) and size + len(texts[k]) <= PIECE:
                part.append((k, 0, texts[k]))
                size += len(texts[k])
                k += 1
            batches = [part]
        for part in batches:
            raw = np.frombuffer(b"".join(x for _, _, x in part), np.uint8)
            ends = np.cumsum([len(x) for _, _, x in part])
            doc, start, n, h = anchor_runs(raw, ends)
            if len(doc):
                keep, times = merge_periods(raw, doc, start + np.r_[0, ends[:-1]][doc], n, h)
                doc, start, n, h = (x[keep] for x in (doc, start, n, h))
                yield np.array([x for x, _, _ in part])[doc], start + np.array([x for _, x, _ in part])[doc], n, times, h


RUNS = "row long, h long, start int, n int, times int"


def anchors(rows: DataFrame) -> DataFrame:
    """``RUNS`` of each text: ``times`` runs of ``n`` windows follow each other from ``start`` with the same context."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            row = np.array(b["row"], np.int64)
            for text, start, n, times, h in runs_of([t.encode() for t in b["text"]]):
                yield {"row": row[text], "h": h.view(np.int64), "start": start, "n": n, "times": times}

    return arrow_map(rows.select("row", "text"), run, RUNS)


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def split_bands(raw: bytes, h: int, start: int, n: int) -> Iterator[tuple[int, int, int]]:
    """``key, start, n`` of the parts of a run by the place of its anchor in the windows, keyed by what all windows of a band share."""
    context = raw[start : start + n + LENGTH - 1]
    anchor = int(np.flatnonzero(gram_hashes(np.frombuffer(context, np.uint8), GRAM).view(np.int64) == h)[0])
    own = h.to_bytes(8, "little", signed=True)
    k = 0
    while k < n:
        band = (anchor - k) // BAND
        after = min(n, anchor - band * BAND + 1)
        core = anchor - band * BAND
        yield _digest(own, bytes([band]), context[core : core + LENGTH - BAND + 1]), start + k, after - k
        k = after


def split_windows(raw: bytes, h: int, start: int, n: int) -> Iterator[tuple[int, int, int]]:
    """``key, start, 1`` of the windows of a run, keyed by their bytes."""
    own = h.to_bytes(8, "little", signed=True)
    for k in range(start, start + n):
        yield _digest(own, raw[k : k + LENGTH]), k, 1


def with_runs(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Each text that has runs, with them as arrays."""
    at = runs.groupBy("row").agg(F.collect_list(F.struct("h", "start", "n", "times")).alias("r"))
    return texts.join(at.select("row", *(F.col("r")[c].alias(c) for c in ("h", "start", "n", "times"))), "row")


def split_runs(held: DataFrame, split: Callable[[bytes, int, int, int], Iterator[tuple[int, int, int]]]) -> DataFrame:
    """``RUNS`` of the parts of the runs in ``held``; of runs that follow each other, those of the first count for all."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for row, text, *lists in zip(b["row"], b["text"], b["h"], b["start"], b["n"], b["times"], strict=True):
                raw = text.encode()
                out: dict[str, list] = {k: [] for k in ("row", "h", "start", "n", "times")}
                for h, start, n, times in zip(*lists, strict=True):
                    for part in split(raw, h, start, n):
                        for k, v in zip(out, (row, *part, times), strict=True):
                            out[k].append(v)
                    if len(out["row"]) > 50_000:
                        yield out
                        out = {k: [] for k in out}
                yield out

    return arrow_map(held.select("row", "text", "h", "start", "n", "times"), run, RUNS)


def contexts(held: DataFrame) -> DataFrame:
    """``row, start, h, c, weight, context``: each run in ``held`` with the digest of its context.

    Of equal contexts that a worker meets, the first row carries the bytes and
    how many runs have them; the others carry neither.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        rows: dict[str, list] = {k: [] for k in ("row", "start", "h", "c", "weight", "context")}
        seen: dict[tuple[int, int], int] = {}
        held_bytes = 0
        for b in batches:
            for row, text, *lists in zip(b["row"], b["text"], b["h"], b["start"], b["n"], b["times"], strict=True):
                raw = text.encode()
                for h, start, n, times in zip(*lists, strict=True):
                    context = raw[start : start + n + LENGTH - 1]
                    c = _digest(context)
                    at = seen.get((h, c))
                    if at is None:
                        seen[h, c] = len(rows["row"])
                        held_bytes += len(context)
                        weight = times
                    else:
                        rows["weight"][at] += times
                        context = weight = None
                    for k, v in zip(rows, (row, start, h, c, weight, context), strict=True):
                        rows[k].append(v)
                    held_bytes += 40
                    if held_bytes > HELD_BYTES:
                        yield rows
                        rows, seen, held_bytes = {k: [] for k in rows}, {}, 0
        yield rows

    return arrow_map(held.select("row", "text", "h", "start", "n", "times"), run, "row long, start int, h long, c long, weight long, context binary")


def two_stage_sort(raw: bytes, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places with ``wanted`` in the order of their suffixes, which count as equal beyond ``depth`` bytes.

    Suffixes smaller than their successors are sorted directly. The others
    follow from a scan of the buckets of first bytes in rising order: what
    stands before a suffix of the bucket goes to the next free place of its
    own bucket.
    """
    buf = np.frombuffer(raw + b"\x00\xff", np.uint8)
    n = len(buf)
    step = np.sign(buf[1:].astype(np.int16) - buf[:-1].astype(np.int16))
    following = np.where(step != 0, np.arange(n - 1), n - 2)
    following = np.minimum.accumulate(following[::-1])[::-1]
    smaller = np.r_[step[following] > 0, False]
    active = np.r_[wanted, False, False]
    nearest = np.minimum.accumulate(np.where(smaller, np.arange(n), n - 2)[::-1])[::-1]
    last = np.flatnonzero(active[:-1] & ~active[1:])
    reach = np.zeros(n + 1, np.int64)
    np.add.at(reach, last, 1)
    np.add.at(reach, nearest[last] + 1, -1)
    active |= np.cumsum(reach[:-1]) > 0

    seeds = np.flatnonzero(smaller & active)
    text = buf.tobytes()
    direct = np.array(sorted(seeds.tolist(), key=lambda i: text[i : i + depth]), np.int64)
    cut = np.searchsorted(buf[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    larger = active & ~smaller
    for byte in range(256):
        parts = induced[byte]
        if not parts and cut[byte] == cut[byte + 1]:
            continue
        front = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        bucket = [front]
        while len(front):
            before = front[front > 0] - 1
            front = before[larger[before] & (buf[before] == byte)]
            bucket.append(front)
        bucket.append(direct[cut[byte] : cut[byte + 1]])
        full = np.concatenate(bucket)
        out.append(full)
        before = full[full > 0] - 1
        before = before[larger[before] & (buf[before] > byte)]
        if len(before):
            to = buf[before]
            order = np.argsort(to, kind="stable")
            before, to = before[order], to[order]
            at = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            for x, y in zip(at, np.r_[at[1:], len(to)], strict=True):
                induced[to[x]].append(before[x:y])
    places = np.concatenate(out) if out else np.zeros(0, np.int64)
    return places[np.r_[wanted, False, False][places]]


def common_prefixes(raw: bytes, places: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Length of the common prefix, up to ``most``, of each suffix with the one before it in ``places`` (the first: 0)."""
    if not len(places):
        return np.zeros(0, np.int64)
    buf = np.frombuffer(raw + bytes(most), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(buf, most)
    out = [np.zeros(1, np.int64)]
    for k in range(1, len(places), 8192):
        rows = windows[places[k - 1 : k + 8192]]
        differ = rows[1:] != rows[:-1]
        out.append(np.where(differ.any(1), differ.argmax(1), most))
    return np.concatenate(out)


def repeated_windows(parts: list[bytes], weights: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its windows occur twice or more, counting a context ``weights`` times."""
    raw = b"".join(parts)
    sizes = np.array([len(p) for p in parts])
    wanted = np.zeros(len(raw), bool)
    begins = np.r_[0, np.cumsum(sizes)[:-1]]
    for b, s in zip(begins, sizes, strict=True):
        wanted[b : b + s - length + 1] = True
    places = two_stage_sort(raw, wanted, length)
    same = common_prefixes(raw, places, length) >= length
    kind = np.cumsum(~same)
    owner = np.searchsorted(begins, places, side="right") - 1
    total = np.bincount(kind, np.array(weights, float)[owner])
    flags = np.zeros(len(raw), bool)
    flags[places] = total[kind] >= 2
    return [flags[b : b + s - length + 1] for b, s in zip(begins, sizes, strict=True)]


def _ranges(flags: np.ndarray) -> list[dict]:
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


RANGES = "h long, c long, ranges array<struct<lo: int, hi: int>>"


def sort_groups(parts: DataFrame) -> DataFrame:
    """``h, c, ranges``: the windows of each context that repeat; groups of an anchor stay together and are sorted by the run."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        group: dict[tuple[int, int], list] = {}
        windows, now = 0, None

        def done() -> dict:
            found = repeated_windows([v[0] for v in group.values()], [v[1] for v in group.values()])
            kept = [(k, _ranges(f)) for k, f in zip(group, found, strict=True) if f.any()]
            return {"h": [k[0] for k, _ in kept], "c": [k[1] for k, _ in kept], "ranges": [r for _, r in kept]}

        for b in batches:
            for h, c, context, weight in zip(b["h"], b["c"], b["context"], b["weight"], strict=True):
                if h != now and windows >= SORT_WINDOWS:
                    yield done()
                    group, windows = {}, 0
                now = h
                if (h, c) in group:
                    group[h, c][1] += weight
                else:
                    group[h, c] = [context, weight]
                    windows += len(context) - LENGTH + 1
        if group:
            yield done()

    return arrow_map(parts.repartition("h").sortWithinPartitions("h"), run, RANGES)


def with_row_ids(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text`` with a distinct ``row``: doc_id itself, or a stored number where ids repeat or are null."""
    base = docs.select("doc_id", text_or_empty().alias("text"))
    ids = base.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        return base.withColumn("row", F.col("doc_id"))
    return materialize(base.withColumn("row", F.monotonically_increasing_id()), "suffix-rows")


def repeated_spans(texts: DataFrame, runs: DataFrame, large: DataFrame, group_rows: int) -> DataFrame:
    """``row, lo, hi``: bytes that the repeated windows of ``runs`` cover; ``large`` (h) are the groups to split."""
    n_large = large.count()
    if n_large:
        few = runs.join(small_side(large, n_large), "h", "left_anti")
    else:
        few = runs
    known = [materialize(contexts(with_runs(texts, few)), "suffix-contexts")]
    if n_large:
        many = materialize(runs.join(small_side(large, n_large), "h", "left_semi"), "suffix-large")
        bands = materialize(split_runs(with_runs(texts, many), split_bands), "suffix-bands")
        parts = materialize(contexts(with_runs(texts, bands)), "suffix-parts")
        still = parts.groupBy("h", "c").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > group_rows).select("h")
        still = materialize(still, "suffix-still")
        n_still = still.count()
        known.append(parts.join(small_side(still, n_still), "h", "left_anti").select(*parts.columns) if n_still else parts)
        if n_still:
            single = split_runs(with_runs(texts, bands.join(small_side(still, n_still), "h", "left_semi").select(*bands.columns)), split_windows)
            known.append(materialize(contexts(with_runs(texts, single)), "suffix-single"))
    spans = []
    for part in known:
        found = materialize(sort_groups(part.where("context is not null").select("h", "c", "context", "weight")), "suffix-found")
        hits = part.select("row", "start", "h", "c").join(found, ["h", "c"]).select("row", "start", F.explode("ranges").alias("r"))
        spans.append(hits.select("row", (F.col("start") + F.col("r.lo")).alias("lo"), (F.col("start") + F.col("r.hi") - 1 + LENGTH).alias("hi")))
    whole = runs.where("times > 1").select("row", F.col("start").alias("lo"), (F.col("start") + F.col("n") * F.col("times") - 1 + LENGTH).alias("hi"))
    return functools.reduce(DataFrame.unionByName, spans, whole)


def remove_repeats(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary`` for each row of ``docs``.

    A byte goes if it lies in a string of ``LENGTH`` bytes that starts anywhere
    else too, in the same text or another, judged on the input. Null texts are
    empty; texts under ``LENGTH`` bytes stay whole; rows that repeat are copies
    of each other; long texts are looked at in pieces of ``PIECE`` bytes, and
    what travels with a text is one row a run; extra columns are not read,
    whatever their names; an empty table gives no rows. ``kept`` is null where
    nothing was removed. ``group_rows`` bounds one sort and has no effect on
    results.
    """
    rows = with_row_ids(docs)
    facts = materialize(rows.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole_sha256")), "suffix-facts")
    every = materialize(anchors(rows), "suffix-runs")
    # stored, so that the join below is of two shuffles and a frequent anchor's is split
    counts = materialize(every.groupBy("h").agg(F.sum("times").alias("m")).where("m > 1"), "suffix-counts")
    runs = materialize(every.join(counts.select("h"), "h").select(*every.columns), "suffix-again")
    release(every)
    mine = materialize(runs.select("row").distinct(), "suffix-rows-again")
    texts = rows.select("row", "text").join(small_side(mine, mine.count()), "row", "left_semi")
    texts = materialize(texts, "suffix-texts")
    spans = repeated_spans(texts, runs, counts.where(F.col("m") > group_rows).select("h"), group_rows)
    per = spans.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("s"))

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("row", "n_removed", "n_spans", "kept_sha256", "kept")}
            for row, text, lo, hi in zip(b["row"], b["text"], b["lo"], b["hi"], strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, lo, 1)
                np.subtract.at(edge, hi, 1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = raw[~gone].tobytes()
                for k, v in zip(out, (row, int(gone.sum()), int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1)), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    out[k].append(v)
            yield out

    both = texts.join(per.select("row", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi")), "row").select("row", "text", "lo", "hi")
    changed = arrow_map(both, cut, "row long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    zero = F.lit(0).cast("long")
    return facts.join(changed, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept"
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: Every window by its hash, without anchors or suffixes; the removed runs; what lies between them. Texts as hexadecimal digits, two a byte.
ORACLE = """
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT row, p, md5_number(substr(x, 2 * p + 1, 400)) AS h FROM (SELECT row, x, unnest(range(len(x) // 2 - 199)) AS p FROM d) AS t),
r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
k AS (SELECT row, p, coalesce(p > lag(p) OVER (PARTITION BY row ORDER BY p) + 200, true) AS fresh FROM w JOIN r USING (h)),
s AS (SELECT row, min(p) AS lo, max(p) + 200 AS hi FROM (SELECT row, p, sum(fresh::INT) OVER (PARTITION BY row ORDER BY p) AS g FROM k) AS t GROUP BY row, g),
b AS (SELECT row, hi AS lo, lead(lo) OVER (PARTITION BY row ORDER BY lo) AS hi FROM s UNION ALL SELECT row, 0, min(lo) FROM s GROUP BY row),
p AS (SELECT row, string_agg(substr(x, 2 * lo + 1, 2 * (coalesce(hi, len(x) // 2) - lo)), '' ORDER BY lo) AS left_over FROM b JOIN d USING (row) GROUP BY row),
c AS (SELECT row, sum(hi - lo)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM s GROUP BY row)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_over, x))) AS kept_sha256
FROM d LEFT JOIN p USING (row) LEFT JOIN c USING (row)
"""
