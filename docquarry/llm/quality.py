"""Quality classifier with hierarchical empirical Bayes.

1. Evidence: a logistic model over shares that DataFrame functions count in each whole text (symbols, capitals, bars,
   repeated lines and words, ...). It is fitted on a bounded sample of labelled rows (``max_labelled``).
2. Sites: ``source`` is a host, with a path after its first ``/`` if it has one. Over all documents, grouped sums give
   every host's and every path's number of documents and expected number of good ones.
3. Shrinkage: a path's rate is drawn to its host's and a host's to the global one, each by a strength that the spread
   of the rates themselves gives (method of moments): sparse sites end near their parents.
4. Posterior: the log odds of the evidence plus those of the path's posterior rate against the global rate.

The evidence of each text is computed once and written with the row; sums and posteriors read it from there. The sums are of
whole millionths, so they don't depend on the order of rows.

Defined results: null or blank text is rejected with score 0; a null source is the host ''; rows with equal content get
equal results; a table without labels gets the evidence of a fixed prior model; of labelled rows that repeat an id, one (the
least features) is learnt from; an empty table gives no rows. Other columns are handed through by ``keep_good``, whatever
their names, and left out by ``score_documents``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FEATURES = ("symbols", "capitals", "bars", "bangs", "digits", "repeated_lines", "spaces", "letters_per_word", "brevity")
#: For tables without labels: noise speaks against a document.
PRIOR_WEIGHTS = (4.0, -30.0, -6.0, -60.0, -60.0, -5.0, -4.0, 0.0, 0.0, 0.0)
MILLION = 1_000_000
#: Sites (of about 100 bytes) up to which their table is broadcast; beyond, rows and sites are shuffled to each other.
BROADCAST_SITES = 100_000


def features(text: Column) -> list[Column]:
    """One double column for each of FEATURES, over the whole text."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    kept = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lower = F.lower(t)
    capitals = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    lines = F.split(t, "\n", -1)
    words = F.size(F.split(F.trim(F.translate(t, "\n\t\r", "   ")), " +", -1)).cast("double")
    letters = F.length(F.regexp_replace(lower, r"[^\p{L}]+", "")).cast("double")
    return [
        (kept("#$%&*@^~<>{}[]\\=+_`") / n).alias("symbols"),
        (capitals / F.greatest(letters, F.lit(1.0))).alias("capitals"),
        (kept("|") / n).alias("bars"),
        (kept("!?") / n).alias("bangs"),
        (kept("0123456789") / n).alias("digits"),
        (F.lit(1.0) - F.size(F.array_distinct(lines)) / F.size(lines)).alias("repeated_lines"),
        (kept(" ") / n).alias("spaces"),
        (letters / words / 10.0).alias("letters_per_word"),
        (F.lit(1.0) / (F.lit(1.0) + n / 100.0)).alias("brevity"),
    ]


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the intercept comes first."""
    scale = np.maximum(x.std(0), 1e-6)
    a = np.c_[np.ones(len(x)), x / scale]
    w = np.zeros(a.shape[1])
    penalty = ridge * len(x) * np.r_[0, np.ones(x.shape[1])]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - penalty * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-6)
        step = np.linalg.solve(h, g)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[0], w[1:] / scale]


def learn_evidence(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Weights of the evidence, fitted on at most about ``max_labelled`` labelled rows chosen by a hash of the id."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = known.count()
    if total == 0:
        return list(PRIOR_WEIGHTS)
    share = min(1.0, max_labelled / total)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = known.where(place < share).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    features_ = F.struct(*features(F.col("_text")))
    got = rows.groupBy("_id", F.col("quality").cast("double").alias("quality")).agg(F.min(features_).alias("_features")).select("_id", "quality", "_features.*").collect()
    got.sort(key=lambda r: tuple(r))
    table = np.array([list(r)[1:] for r in got], float)
    if not len(table) or len(set(table[:, 0])) < 2:
        return list(PRIOR_WEIGHTS)
    return [float(v) for v in fit_weights(table[:, 1:], table[:, 0])]


def _site(source: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(F.coalesce(source, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    return F.lower(F.substring_index(bare, "/", 1)), F.regexp_extract(bare, "^[^/]*/([^/?#]*)", 1)


def _strength(groups: DataFrame, parent_rate: Column) -> Column:
    """Aggregate: the number of documents that a parent's rate is worth (moments of the rates about their parents)."""
    rate = F.col("good") / F.col("n")
    spread = F.sum(F.col("n") * (rate - parent_rate) * (rate - parent_rate)) / F.sum("n")
    even = F.sum(parent_rate * (1 - parent_rate)) / F.sum("n")  # the spread that counting alone gives
    between = F.greatest(spread - even, F.lit(1e-6))
    mean_var = F.sum(F.col("n") * parent_rate * (1 - parent_rate)) / F.sum("n")
    return F.least(F.greatest(mean_var / between - 1, F.lit(1.0)), F.lit(1e6))


def _scored(docs: DataFrame, carried: Column, weights: list[float], text_col: str, source_col: str) -> DataFrame:
    """``carried`` as _row, with _z, _host_rate, _path_rate and _quality, of every row."""
    host, path = _site(F.col(source_col))
    z = F.lit(weights[0])
    for w, f in zip(weights[1:], features(F.col(text_col))):
        z = z + F.lit(w) * f
    z = F.greatest(F.least(z, F.lit(20.0)), F.lit(-20.0))
    blank = F.col(text_col).isNull() | ~F.col(text_col).rlike(r"\S")
    rows = written(docs.select(carried.alias("_row"), host.alias("_host"), path.alias("_path"), F.when(~blank, z).alias("_z")), "evidence")
    # the sums of a hot host are partly added before any shuffle
    p = F.round(F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z"))), F.lit(0.0)) * MILLION).cast("long")
    paths = rows.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum(p).alias("good_millionths"))
    paths = paths.withColumn("good", F.col("good_millionths") / MILLION)
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), (F.sum("good_millionths") / MILLION).alias("good"))
    world = hosts.agg((F.sum("good") / F.sum("n")).alias("world"))
    bounded = F.greatest(F.least(F.col("world"), F.lit(0.999)), F.lit(0.001))
    world = world.select(bounded.alias("world"))
    host_strength = hosts.join(F.broadcast(world)).agg(_strength(hosts, F.col("world")).alias("host_strength"), F.max("world").alias("world"))
    host_rates = hosts.join(F.broadcast(host_strength)).select("_host", "world", ((F.col("good") + F.col("host_strength") * F.col("world")) / (F.col("n") + F.col("host_strength"))).alias("host_rate"))
    with_hosts = paths.join(host_rates, "_host")
    path_strength = with_hosts.agg(_strength(with_hosts, F.col("host_rate")).alias("path_strength"))
    sites = with_hosts.join(F.broadcast(path_strength)).select(
        "_host", "_path", "world", "host_rate", ((F.col("good") + F.col("path_strength") * F.col("host_rate")) / (F.col("n") + F.col("path_strength"))).alias("path_rate")
    )
    sites = written(sites, "sites")
    joined = rows.join(F.broadcast(sites) if sites.count() <= BROADCAST_SITES else sites, ["_host", "_path"])
    odds = lambda r: F.log(r / (1 - r))
    kept_in = lambda c: F.greatest(F.least(F.col(c), F.lit(0.999)), F.lit(0.001))
    posterior = F.col("_z") + odds(kept_in("path_rate")) - odds(kept_in("world"))
    quality = F.when(F.col("_z").isNull(), F.lit(0.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-posterior)))
    return joined.select("_row", "_z", F.col("host_rate").alias("_host_rate"), F.col("path_rate").alias("_path_rate"), quality.alias("_quality"))


def score_documents(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """``id_col``, evidence, host_rate, path_rate, quality (0 to 1) and good (boolean) of every row."""
    scored = _scored(docs, F.struct(F.col(id_col).alias("id")), weights, text_col, source_col)
    own = {"evidence": F.col("_z"), "host_rate": F.col("_host_rate"), "path_rate": F.col("_path_rate"), "quality": F.col("_quality"), "good": F.col("_quality") >= threshold}
    return scored.select(F.col("_row.id").alias(id_col), *[v.alias(k) for k, v in own.items()])


def keep_good(docs: DataFrame, weights: list[float], threshold: float = 0.5, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, whose posterior is at least ``threshold``."""
    return _scored(docs, F.struct("*"), weights, text_col, source_col).where(F.col("_quality") >= threshold).select("_row.*")
