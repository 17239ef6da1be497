"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A logistic model, fitted on a bounded sample of labelled rows, scores each
document from surface features. Scores are summed per host and per path with
partial aggregation; a host's mean is shrunk to the global mean and a path's to
its host's, both with a strength estimated from the spread between groups. The
document's evidence is then moved by how its site differs from the corpus,
leaving out the document's own part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, small_side, table, text_or_empty

#: Labelled rows that the classifier is fitted on, at most: those first by a hash of doc_id.
TRAIN_ROWS = 20_000
#: A document goes if its posterior is below this.
REJECT_BELOW = 0.5
#: Weight of the site's log-odds against the document's.
SITE_WEIGHT = 0.5

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 sentence mark, 7 symbol, 8 over ASCII
_KIND[[*range(97, 123)]] = 1
_KIND[[*range(65, 91)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[[32, 9]] = 4
_KIND[[10, 13]] = 5
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 6
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 7
_KIND[128:] = 8
#: Marks counted one by one.
MARKS = "!|#$%&*{}<>_"
N_FEATURES = 9 + 9 + len(MARKS) + 9


def features(text: str) -> np.ndarray:
    """Shares of byte kinds and of their successions, marks, and figures on words and lines."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    kind = _KIND[raw]
    count = np.bincount(kind, minlength=9)
    alternating = np.bincount(kind[1:][kind[1:] != kind[:-1]], minlength=9) if len(raw) > 1 else np.zeros(9)
    byte = np.bincount(raw, minlength=256)
    words = text.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x]
    ends = np.array([x[-1] for x in words] or ["."])
    extra = [
        np.log1p(len(words)),
        len(set(words)) / w,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(lengths.mean() if len(words) else 0),
        np.log1p(lengths.max(initial=0)),
        lengths.std() if len(words) else 0.0,
        float(np.mean(~np.char.isalnum(ends))),
        len(lines) / w,
        count[2] / max(1, count[1] + count[2]),
    ]
    return np.concatenate([count / n, alternating / n, [10 * byte[ord(c)] / n for c in MARKS], extra])


def feature_table(docs: DataFrame) -> DataFrame:
    """``doc_id, host, path, x``: features of each whole text (null: empty)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {k: b[k] for k in ("doc_id", "host", "path")} | {"x": [features(t).tolist() for t in b["text"]]}

    return arrow_map(docs.select("doc_id", "host", "path", text_or_empty().alias("text")), run, "doc_id long, host string, path string, x array<double>")


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents, chosen by a hash of doc_id.

    A doc_id that is labelled twice counts with its lower label; of several
    texts under one doc_id the one with the least features counts, so the model
    does not depend on order and no more than ``rows`` rows reach the driver.
    """
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = docs.select("doc_id", F.lit("").alias("host"), F.lit("").alias("path"), "text").join(F.broadcast(lab), "doc_id", "left_semi")
    one = feature_table(got).groupBy("doc_id").agg(F.min("x").alias("x"))
    got = one.join(F.broadcast(lab), "doc_id").select("doc_id", "x", "quality").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), float).reshape(-1, N_FEATURES)
    return x, got["quality"].to_numpy(float)


class Model:
    """Logistic regression on standardised features, by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> None:
        if len(y) == 0 or y.min() == y.max():  # nothing to tell apart: the smoothed share alone
            self.mean, self.scale, self.w = np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1)
            p = (y.sum() + 1) / (len(y) + 2)
            self.w[-1] = np.log(p / (1 - p)) if len(y) else 2.0
            return
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = self._z(x)
        self.w = np.zeros(N_FEATURES + 1)
        penalty = np.full(N_FEATURES + 1, ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, z.T @ (y - p) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that the document is good, within 0.001 to 0.999."""
        return np.clip(1 / (1 + np.exp(-np.clip(self._z(x) @ self.w, -30, 30))), 1e-3, 1 - 1e-3)


def score_table(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            x = np.array([features(t) for t in b["text"]]).reshape(-1, N_FEATURES)
            yield {k: b[k] for k in ("doc_id", "host", "path")} | {"p": model.score(x).tolist()}

    return arrow_map(docs.select("doc_id", "host", "path", text_or_empty().alias("text")), run, "doc_id long, host string, path string, p double")


def _strength(groups: DataFrame, prior: str) -> float:
    """Pseudo-count by the method of moments: spread within groups over spread between them, within 1 to 1000."""
    r = groups.where("n > 1").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(prior), 2)).alias("between"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
        F.count("*").alias("g"),
    ).head()
    if not r["g"] or r["n"] <= r["g"]:
        return 10.0
    within = max(r["within"] / (r["n"] - r["g"]), 1e-9)
    between = max(r["between"] / r["n"] - within * r["g"] / r["n"], 1e-9)
    return float(min(1000.0, max(1.0, within / between)))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, train_rows: int = TRAIN_ROWS, site_weight: float = SITE_WEIGHT, reject_below: float = REJECT_BELOW) -> DataFrame:
    """``doc_id, host, path, p_doc, host_posterior, path_posterior, p_quality, keep`` for each row of ``docs``.

    ``host`` defaults to ``source`` and ``path`` to ``lang``; for web pages pass
    parts of the URL. Null hosts and paths are groups of their own, null texts
    count as empty, without labels of both kinds every document has the same
    score, rows that repeat get the same result each, a text of any length is
    read whole, and columns of ``docs`` named like the result's are not read.
    An empty table gives no rows.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    base = docs.select("doc_id", F.coalesce(host.cast("string"), F.lit("\0null")).alias("host"), F.coalesce(path.cast("string"), F.lit("\0null")).alias("path"), "text")
    model = Model(*training_rows(docs, labels, train_rows))
    scores = materialize(score_table(base, model), "quality-scores")
    stats = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = materialize(scores.groupBy("host", "path").agg(*stats), "quality-paths")
    n_paths = paths.count()
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).head()
    mean = float((total["s"] or 0.0) / max(1, total["n"] or 0)) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q"))).withColumn("m", F.lit(mean))
    k_host = _strength(hosts, "m")
    hosts = hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs"), ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_posterior"))
    sites = paths.join(hosts, "host")
    k_path = _strength(sites, "host_posterior")
    sites = sites.select("host", "path", F.col("n").alias("pn"), F.col("s").alias("ps"), "hn", "hs", "host_posterior")
    out = scores.join(small_side(sites, n_paths), ["host", "path"], "left")
    others_host = (F.col("hs") - F.col("p") + k_host * mean) / (F.col("hn") - 1 + k_host)
    others_path = (F.col("ps") - F.col("p") + k_path * others_host) / (F.col("pn") - 1 + k_path)
    logit = lambda c: F.log(c / (1 - c))
    within = lambda c: F.least(F.greatest(c, F.lit(1e-3)), F.lit(1 - 1e-3))
    odds = logit(F.col("p")) + F.lit(site_weight) * (logit(within(F.col("path_posterior"))) - logit(within(F.lit(mean))))
    out = out.withColumn("path_posterior", others_path).withColumn("p_quality", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "host", "path", F.col("p").alias("p_doc"), "host_posterior", "path_posterior", "p_quality", (F.col("p_quality") >= reject_below).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, columns as given. Rows with a null doc_id stay."""
    rejected = materialize(classify(docs, labels, **options).where("not keep").select("doc_id").distinct(), "quality-rejected")
    return docs.join(small_side(rejected, rejected.count()), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
