"""The pipeline against its stages done by hand on the smallest table."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np

import corpus_pipeline
from weftgraph.llm import near_dedup, quality, records

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    """Each stage by loops in this process: posteriors, shingle sets at 80 %, template windows, shares, whole-text encoding."""
    from test_operators import WORDS, brute_components, brute_leaks, brute_posteriors, brute_targets
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    good = {r["doc_id"] for r, (_, _, p) in zip(scored, brute_posteriors(scored), strict=True) if p >= 0.5}
    left = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in good}
    component = brute_components({d: r["text"] or "" for d, r in left.items()}, 80)
    left = {d: r for d, r in left.items() if component[d][1] == d}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    gone = {d for d, _ in brute_leaks({d: r["text"] or "" for d, r in left.items()}, items)}
    left = {d: r for d, r in left.items() if d not in gone}
    size = {d: len(WORDS.findall(r["text"] or "")) for d, r in left.items()}
    per = collections.Counter()
    for d, r in left.items():
        per[r["source"]] += size[d]
    targets = brute_targets(per)
    tok = Tokenizer.from_file(records.default_tokenizer())
    expected = []
    for d in sorted(left):
        rate = min(3.0, targets[left[d]["source"]] / per[left[d]["source"]])
        draw = int(hashlib.md5(f"{d}:mix-1".encode()).hexdigest()[:13], 16) / 2**52
        ids = [*tok.encode(left[d]["text"] or "", add_special_tokens=False).ids, records.END_ID]
        expected += [(d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] * (int(rate) + (draw < rate - int(rate)))
    got = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == expected
    assert [r["start"] for r in got] == np.cumsum([0, *(n for _, n, _ in expected)])[:-1].tolist()


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("label", docs_extra())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "label"]


def test_near_duplicates_at_80(spark):
    from test_operators import brute_components

    rng = random.Random(5)
    texts = {}
    hard = 0
    for k in range(6000):  # pairs in which a run of words is changed; of those at 0.80, more that 23 symbols do not reach
        w = [f"p{k}x{i}" for i in range(204)]
        n = 6 + k % 20 if k < 100 else 18
        at = rng.randrange(10, 190 - n)
        pair = [" ".join(w), " ".join([*w[:at], *(f"q{k}x{i}" for i in range(n)), *w[at + n :]])]
        x, y = map(near_dedup.signature, near_dedup.shingle_sets(pair))
        far = k >= 100 and (x != y).sum() > 23
        hard += far
        if k < 100 or far:
            texts[2 * k], texts[2 * k + 1] = pair
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in near_dedup.keep_one(docs, percent=80).collect()}
    at_80, at_85 = ({d for d, (_, c) in brute_components(texts, percent).items() if d == c} for percent in (80, 85))
    assert hard and kept == at_80 and len(at_80) < len(at_85)


def test_miss_rate():
    for percent in (80, 85, 90):
        assert near_dedup._miss(near_dedup.chunks_for(percent), percent) <= near_dedup._miss(near_dedup.CHUNKS, near_dedup.PERCENT) < 1e-5
    rng = np.random.default_rng(3)
    chunks = near_dedup.chunks_for(80)
    for _ in range(200):
        a = rng.integers(0, 65536, near_dedup.SYMBOLS).astype("<u2")
        b = a.copy()
        b[rng.choice(near_dedup.SYMBOLS, 2 * chunks - 1, replace=False)] ^= 1
        ka, kb = near_dedup.chunk_keys(np.stack([a, b]), chunks)
        assert (ka == kb).any()


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")
