"""Components and feature selection (P-20 to P-29, P-60)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from colloquy.operators.aggregates import melt
from colloquy.operators.scan import quantiles, attach
from colloquy.session import cut
from .models import _grouped, _matrix, centred_moments
from .moments import correlation_matrix, spearman_by
from .draws import replicate_key
from .resample import percentile_ci, replicate_moments


def _corr_from(s, n):
    c = s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:]) / n
    d = np.sqrt(np.maximum(np.diag(c), 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(np.outer(d, d) > 0, c / np.outer(d, d), 0.0)
    return r


def _eigen(r, k):
    """Largest k eigenpairs; the largest loading of each component is positive."""
    w, v = np.linalg.eigh(r)
    o = np.argsort(w)[::-1][:k]
    w, v = np.maximum(w[o], 0.0), v[:, o]
    return w, v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])


def pca_fit(df: DataFrame, cols: Sequence[str], k: int, keys: Sequence[str] = ()) -> DataFrame:
    """P-20: components of the standardised columns (complete rows), per key.

    Spark reduces the rows to one p x p matrix per key; its eigenvectors are the only
    thing computed from a whole matrix. Rows: component, feature, weight, loading,
    eigenvalue, share of variance.
    """
    cols = list(cols)
    g = centred_moments(df, keys, cols)

    def run(pdf):
        s, n, _m = _matrix(pdf, len(cols))
        w, v = _eigen(_corr_from(s, n), k)
        return pd.DataFrame([
            (j + 1, c, float(v[i, j]), float(v[i, j] * np.sqrt(w[j])), float(w[j]), float(w[j] / len(cols)))
            for j in range(len(w)) for i, c in enumerate(cols)
        ], columns=["component", "feature", "weight", "loading", "eigenvalue", "variance_share"])

    return _grouped(g, keys, run, "component int, feature string, weight double, loading double, eigenvalue double, variance_share double")


def pca_scores(df: DataFrame, fit: DataFrame, cols: Sequence[str], k: int, reference: DataFrame | None = None) -> DataFrame:
    """P-20 / E-19: project rows; z-scores use the reference (default: the same rows)."""
    ref = (df if reference is None else reference).na.drop(subset=list(cols))
    m = ref.agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    w = fit.agg(*[
        F.max(F.when((F.col("component") == j) & (F.col("feature") == c), F.col("weight"))).alias(f"_w{j}_{c}")
        for j in range(1, k + 1) for c in cols
    ])
    d = attach(attach(df, m, []), w, [])
    z = {c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in cols}
    pcs = [sum((z[c] * F.col(f"_w{j}_{c}") for c in cols), F.lit(0.0)).alias(f"PC{j}") for j in range(1, k + 1)]
    return d.select(*df.columns, *pcs)


def orient(scores: DataFrame, component: str, reference: str) -> DataFrame:
    """P-21: flip a component so that it rank-correlates positively with a reference."""
    r = spearman_by(scores, [], component, reference).select(F.when(F.col("rho") < 0, -1.0).otherwise(1.0).alias("_sign"))
    return attach(scores, r, []).withColumn(component, F.col(component) * F.col("_sign")).drop("_sign")


def wishart_correlations(n: int, p: int, iterations: np.ndarray, seed: int) -> np.ndarray:
    """(iteration, p, p): correlation matrices of ``n`` rows of independent normal columns, without the rows.

    Their centred cross products have a Wishart distribution with n - 1 degrees of freedom. By Bartlett's decomposition
    they are L times its transpose, with roots of chi-square values on the diagonal of L and normal values below.
    """
    out = np.empty((len(iterations), p, p))
    for i, key in enumerate(replicate_key(seed, iterations)):
        rng = np.random.Generator(np.random.PCG64(int(key)))
        low = np.tril(rng.standard_normal((p, p)), -1)
        low[np.diag_indices(p)] = np.sqrt(rng.chisquare(np.maximum(n - 1 - np.arange(p), 1e-12)))
        c = low @ low.T
        d = np.sqrt(np.diag(c))
        out[i] = c / np.outer(d, d)
    return out


def parallel_analysis(df: DataFrame, cols: Sequence[str], n_iter: int, percentile: float = 0.95, seed: int = 42) -> DataFrame:
    """P-22: observed eigenvalues against those of random data of the same shape.

    An iteration draws one p x p matrix whose distribution is that of the random rows' cross products, whatever their
    number; iterations are spread over the tasks.
    """
    cols = list(cols)
    p = len(cols)
    base = cut(df.na.drop(subset=cols).select(*cols))
    spark = df.sparkSession
    draws = attach(spark.range(0, n_iter).select(F.col("id").alias("it")), base.agg(F.count("*").alias("n")), [])

    def run(batches):
        for pdf in batches:
            if len(pdf):
                w = np.linalg.eigvalsh(wishart_correlations(int(pdf["n"].iloc[0]), p, pdf["it"].to_numpy(), seed))[:, ::-1]
                yield pd.DataFrame({"it": np.repeat(pdf["it"].to_numpy(), p), "component": np.tile(np.arange(1, p + 1), len(pdf)), "stat": np.maximum(w, 0).ravel()})

    rand = quantiles(cut(draws.mapInPandas(run, "it long, component int, stat double")), ["component"], "stat", {"threshold": percentile})
    obs = pca_fit(base, cols, p).select("component", "eigenvalue", "variance_share").distinct()
    o = obs.join(rand, "component")
    return o.withColumn("retained", F.col("eigenvalue") > F.col("threshold")).withColumn("kaiser", F.col("eigenvalue") > 1)


def bootstrap_stability(df: DataFrame, unit: str, cols: Sequence[str], k: int, replicates: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """P-24: loading intervals and cosine similarity of components over resamples."""
    cols = list(cols)
    p = len(cols)
    d = df.na.drop(subset=cols)
    m = d.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    d = cut(attach(d, m, []).select(F.col(unit).alias("unit"), *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in cols]))
    pairs = [(a, b) for a in range(p) for b in range(a, p)]
    moments = replicate_moments(d, [], "unit", cols, replicates, seed)
    ref = cut(pca_fit(d, cols, k))
    refw = ref.groupBy().agg(F.collect_list(F.struct("component", "feature", "weight")).alias("_ref"))  # p x k entries

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                ref_v = np.zeros((p, k))
                for e in r.ref_:
                    ref_v[cols.index(e["feature"]), e["component"] - 1] = e["weight"]
                s = np.zeros((p + 1, p + 1))
                for i in range(p):
                    s[0, i + 1] = s[i + 1, 0] = getattr(r, f"s{i}")
                for a, b in pairs:
                    s[a + 1, b + 1] = s[b + 1, a + 1] = getattr(r, f"q{a}_{b}")
                w_, v = _eigen(_corr_from(s, r.n), k)
                cos = (v * ref_v).sum(axis=0)
                v = v * np.where(cos < 0, -1.0, 1.0)
                for c in range(k):
                    rows += [(r.b, c + 1, cols[i], float(v[i, c]), abs(float(cos[c]))) for i in range(p)]
            yield pd.DataFrame(rows, columns=["b", "component", "feature", "stat", "cosine"])

    m2 = attach(moments, refw.withColumnRenamed("_ref", "ref_"), [])
    reps = cut(m2.mapInPandas(run, "b int, component int, feature string, stat double, cosine double"))
    key = ["component", "feature"]
    load = reps.groupBy(*key).agg(F.avg("stat").alias("loading_mean"), F.stddev_samp("stat").alias("loading_std"), F.count("*").alias("n_boot"))
    load = load.join(percentile_ci(reps, key), key)
    cos = reps.select("b", "component", F.col("cosine").alias("stat")).distinct()
    comp = cos.groupBy("component").agg(F.avg("stat").alias("cosine_mean"), F.stddev_samp("stat").alias("cosine_std"))
    return load, comp.join(percentile_ci(cos, ["component"]), "component")


def top_loadings(fit: DataFrame, k: int) -> DataFrame:
    """P-60: strongest features of each component."""
    g = fit.groupBy("component").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.abs("loading").alias("a"), "feature", "loading")), asc=False), 1, k).alias("_t"))
    return g.select("component", F.posexplode("_t").alias("rank", "_e")).select(
        "component", (F.col("rank") + 1).alias("rank"), F.col("_e.feature").alias("feature"), F.round("_e.loading", 6).alias("loading"),
        F.when(F.col("_e.loading") >= 0, "+").otherwise("-").alias("sign"),
    )


def near_zero_variance(df: DataFrame, cols: Sequence[str], cv: float = 0.05) -> DataFrame:
    """P-25: features with |sd / mean| below the threshold."""
    l = melt(df, [], cols).groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    c = F.when(F.abs("_m") >= 1e-12, F.abs(F.col("_s") / F.col("_m")))
    return l.select("feature", "n", c.alias("cv"), F.coalesce(c < cv, F.lit(False)).alias("near_zero_variance"))


def redundancy_pairs(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    """P-27: feature pairs whose |r| reaches the threshold."""
    return correlation_matrix(df, cols).where(F.abs("r") >= threshold)


def prune_correlated(
    edges: DataFrame, features: DataFrame, threshold: float = 0.85, protected_pairs: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """P-26: drop one feature of every strongly correlated pair, strongest pair first.

    ``edges``: x, y, r. ``features``: feature, n_missing, priority. The less complete,
    then lower-priority, then longer-named feature of a pair goes. An edge that is the
    best one left at both ends is next for the sequential rule whatever happens
    elsewhere, so every round decides all such edges at once.
    """
    guarded = sorted({f for p in protected_pairs for f in p})
    prot = F.col("feature").isin(guarded) if guarded else F.lit(False)
    f = features.select("feature", F.struct((~prot).cast("int").alias("g"), "n_missing", "priority", F.length("feature").alias("l"), "feature").alias("k"))
    e = edges.where(F.abs("r") > threshold).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.abs("r").alias("a"))
    if guarded:
        e = e.where(~(F.col("x").isin(guarded) & F.col("y").isin(guarded)))
    e = e.join(f.select(F.col("feature").alias("x"), F.col("k").alias("kx")), "x").join(f.select(F.col("feature").alias("y"), F.col("k").alias("ky")), "y")
    e = cut(e.select("x", "y", "a", F.when(F.col("kx") < F.col("ky"), F.col("y")).otherwise(F.col("x")).alias("out")))
    dropped = None
    while not e.isEmpty():
        rank = F.struct((-F.col("a")).alias("a"), "x", "y")
        ends = e.select(F.explode(F.array("x", "y")).alias("node"), rank.alias("rk")).groupBy("node").agg(F.min("rk").alias("best"))
        b = e.withColumn("rk", rank)
        b = b.join(ends.select(F.col("node").alias("x"), F.col("best").alias("bx")), "x").join(ends.select(F.col("node").alias("y"), F.col("best").alias("by")), "y")
        new = cut(b.where("rk = bx and rk = by").select(F.col("out").alias("feature"), F.when(F.col("out") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("kept_instead"), F.col("a").alias("abs_r")))
        dropped = new if dropped is None else dropped.unionByName(new)
        gone = new.select("feature")
        e = cut(e.join(gone.withColumnRenamed("feature", "x"), "x", "left_anti").join(gone.withColumnRenamed("feature", "y"), "y", "left_anti"))
    base = features.select("feature")
    if dropped is None:
        return base.select("feature", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("kept_instead"), F.lit(None).cast("double").alias("abs_r"))
    return base.join(dropped, "feature", "left").select("feature", F.col("abs_r").isNull().alias("kept"), "kept_instead", "abs_r")


def cluster_representatives(clusters: DataFrame, scores: DataFrame) -> DataFrame:
    """P-28: one feature per cluster: target correlation, priority, missing, name length.

    ``scores``: feature, target_corr, priority, n_missing.
    """
    s = clusters.join(scores, "feature")
    order = F.struct(-F.coalesce("target_corr", F.lit(0.0)), "priority", "n_missing", F.length("feature"), "feature")
    best = s.groupBy("cluster").agg(F.min_by("feature", order).alias("_b"))
    return s.join(best, "cluster").select("cluster", "feature", (F.col("feature") == F.col("_b")).alias("selected"))


def feature_clusters(edges: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """P-29: connected parts of the graph of pairs with |r| at or above the threshold."""
    from .network import connected_components

    e = edges.where(F.abs("r") >= threshold).select("x", "y")
    return connected_components(e, features.select(F.col("feature").alias("node"))).select(F.col("node").alias("feature"), F.col("component").alias("cluster"))
