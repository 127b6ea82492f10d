"""Quality classifier: document evidence combined with host- and path-level posteriors by hierarchical empirical Bayes.

A logistic model of text figures, trained here on a bounded labelled sample, gives each
document a log likelihood ratio. Its probabilities, over all documents, are aggregated to
paths, hosts and the whole; method-of-moments strengths shrink a path toward its host and a
host toward the global mean, the sparser the stronger. A document's posterior log odds are
its own evidence plus the log odds of its path's prior, from which it is itself left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm.common import labelled_rows, materialize, small_enough

#: Most labelled documents of each class that training reads.
TRAIN_PER_CLASS = 2000
#: Posterior probability of good quality from which a document stays.
THRESHOLD = 0.5
#: Most path rows that are broadcast; beyond, they are joined by a salted shuffle.
BROADCAST_PATHS, SALTS = 50_000, 32
#: Prior strengths (documents) lie in these bounds.
STRENGTH = (1.0, 10_000.0)
#: How far a site's history may move the log odds either way.
MAX_SITE_SHIFT = 2.0

_UPPER, _DIGIT, _SYMBOLS = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>"
N_FIGURES = 12
#: Buckets that a text's distinct words are hashed to; their shares are further figures.
WORD_BUCKETS = 128


def figures(text: str | None) -> list[float]:
    """Length-free figures of a whole text, each about 0 to 1: N_FIGURES of its surface, then the shares of hashed words."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))

    def share(chars: bytes) -> float:
        return (size - len(raw.translate(None, chars))) / size

    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    letters = sum(map(len, words))
    shares = [0.0] * WORD_BUCKETS
    different = set(words)
    for w in different:
        shares[zlib.crc32(w) % WORD_BUCKETS] += 1 / len(different)
    return [
        1.0,
        min(1.0, 5 * share(_SYMBOLS)),
        share(_UPPER),
        min(1.0, 5 * share(_DIGIT)),
        min(1.0, raw.count(b"|") / n),
        min(1.0, raw.count(b"!") / n),
        1 - len(different) / n,
        1 - len(set(windows)) / len(windows) if windows else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(1.0, letters / n / 20),
        min(1.0, (raw.count(b".") + raw.count(b",")) / n),
        float(len(words) < 4),
        *shares,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Newton's method on the class-balanced, regularised log likelihood."""
    w = np.zeros(x.shape[1])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - l2 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return w


def train(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights whose sum is a log likelihood ratio (classes weigh alike); zeros without both classes.

    Reads at most TRAIN_PER_CLASS documents of each class, those with the smallest hash of the id.
    """
    rows = labelled_rows(documents, labels, TRAIN_PER_CLASS, F.pandas_udf(lambda t: t.map(figures), "array<double>"))
    if len({r.quality for r in rows}) < 2:
        return np.zeros(N_FIGURES + WORD_BUCKETS)
    return fit_logistic(np.array([r.x for r in rows]), np.array([r.quality for r in rows]))


def evidence(text: Column, weights: np.ndarray) -> Column:
    """Log likelihood ratio of good against bad quality for a text column, within ±12."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.clip(np.array([figures(t) for t in texts]).reshape(-1, N_FIGURES + WORD_BUCKETS) @ weights, -12, 12))

    return run(text)


def _moments(groups: DataFrame, n: str, good: str, spread: str) -> tuple[float, float]:
    """Overall mean and prior strength p(1-p)/between - 1 of groups, from the spread of their means beyond what their sizes explain.

    groups: a row per group with its documents, their summed probability and its summed squared deviation.
    """
    mean = F.col(good) / F.col(n)
    row = groups.agg(
        F.sum(n).alias("n"),
        F.sum(good).alias("good"),
        F.sum(F.col(n) * mean * mean).alias("square"),
        F.sum(F.col(spread) / F.col(n)).alias("noise"),
    ).first()
    if not row.n:
        return 0.5, STRENGTH[1]
    m = row.good / row.n
    between = max(row.square / row.n - m * m - row.noise / row.n, 1e-9)
    return m, min(max(m * (1 - m) / between - 1, STRENGTH[0]), STRENGTH[1])


def site_priors(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """Path rows (host, path, n, good, base), the strength that draws a path to its base, and the global mean.

    scored has host, path and p; base is the host's mean, itself drawn to the global mean. The
    aggregations combine before they shuffle, so a host with a third of all rows is no burden.
    """
    stats = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good"), (F.var_pop("p") * F.count("*")).alias("spread"))
    paths = materialize(stats, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"), F.sum("spread").alias("host_spread"))
    overall, host_pull = _moments(hosts, "host_n", "host_good", "host_spread")
    _, path_pull = _moments(paths, "n", "good", "spread")
    base = (F.col("host_good") + F.lit(host_pull) * F.lit(overall)) / (F.col("host_n") + F.lit(host_pull))
    sites = paths.join(hosts.select("host", base.alias("base")), "host").select("host", "path", "n", "good", "base")
    return materialize(sites, "sites"), path_pull, overall


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def with_posterior(documents: DataFrame, corpus: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """columns (all, if None) of documents with a struct column _gs of host, path, evidence, prior, posterior and kept.

    The rows are stored once with their evidence, since the priors need all of them before the
    first verdict; so every text is judged once.
    """
    weights = train(corpus, labels)
    keyed = documents.withColumn("_gs_host", F.coalesce(F.col(host).cast("string"), F.lit(""))).withColumn("_gs_path", F.coalesce(F.col(path).cast("string"), F.lit("")))
    columns = documents.columns if columns is None else columns
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")
    scored = materialize(keyed.select(*columns, "_gs_host", "_gs_path", salt.alias("_gs_salt"), evidence(F.col("text"), weights).alias("_gs_llr")), "evidence")
    p = 1 / (1 + F.exp(-F.col("_gs_llr")))
    sites, pull, overall = site_priors(scored.select(F.col("_gs_host").alias("host"), F.col("_gs_path").alias("path"), p.alias("p")))
    sites = sites.select(F.col("host").alias("_gs_host"), F.col("path").alias("_gs_path"), F.col("n").alias("_gs_n"), F.col("good").alias("_gs_good"), F.col("base").alias("_gs_base"))
    if small_enough(sites, BROADCAST_PATHS):
        joined = scored.join(F.broadcast(sites), ["_gs_host", "_gs_path"])
    else:
        salted = sites.withColumn("_gs_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = scored.join(salted, ["_gs_host", "_gs_path", "_gs_salt"])
    prior = (F.col("_gs_good") - p + F.lit(pull) * F.col("_gs_base")) / (F.col("_gs_n") - 1 + F.lit(pull))
    shift = F.least(F.greatest(_logit(prior) - _logit(F.lit(overall)), F.lit(-MAX_SITE_SHIFT)), F.lit(MAX_SITE_SHIFT))
    odds = F.col("_gs_llr") + _logit(F.lit(overall)) + shift
    posterior = 1 / (1 + F.exp(-odds))
    return joined.withColumn("_gs", F.struct(F.col("_gs_host").alias("host"), F.col("_gs_path").alias("path"), F.col("_gs_llr").alias("evidence"), prior.alias("prior"), posterior.alias("posterior"), (posterior >= threshold).alias("kept")))


def quality_bayes(documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: doc_id, host, path, evidence, prior, posterior, kept.

    A null host or path is the site "". Null and empty texts are judged by their figures as
    texts of no words. Repeated rows each get their row and each count for their site; an empty
    table gives none. Without labelled rows of both classes the evidence is 0 and the prior decides.
    """
    return with_posterior(documents, documents, labels, host, path, threshold, ["doc_id"]).select("doc_id", "_gs.*")


def keep_good(documents: DataFrame, corpus: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of documents whose posterior is good enough, with all their columns."""
    return with_posterior(documents, corpus, labels, host, path).where("_gs.kept").select(*documents.columns)


def op5_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridstone.llm.common import table

    return quality_bayes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
