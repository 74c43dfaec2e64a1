"""Linear models on shared moments (P-30 to P-38, P-41, P-43, P-44, P-51, P-56).

A model is fitted from the p x p moment matrix that ``gram`` reduces the data to; only
that matrix (one per model key) reaches the small solver below.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.operators.scan import average_rank, row_number, attach, scan, with_group_aggs
from colloquy.session import cut
from .dist import chi2_p_value, f_p_value, normal_quantile, t_p_value, t_quantile
from .moments import gram, pearson_by
from .resample import percentile_ci, replicate_moments

FIT = "model string, term string, beta double, se double, t double, df double, n long, rss double, r2 double, adj_r2 double, aic double, bic double"


def dummies(df: DataFrame, col: str, levels: Sequence[str], prefix: str | None = None) -> tuple[DataFrame, list[str]]:
    """Indicator columns for every level but the first."""
    names = [f"{prefix or col}_{lv}" for lv in levels[1:]]
    return df.select("*", *[F.when(F.col(col).isNotNull(), (F.col(col) == lv).cast("double")).alias(n) for lv, n in zip(levels[1:], names)]), names


def centred_interaction(df: DataFrame, a: str, b: str) -> tuple[DataFrame, str]:
    d = with_group_aggs(df, [], _ma=F.avg(a), _mb=F.avg(b))
    return d.withColumn(f"{a}_x_{b}", (F.col(a) - F.col("_ma")) * (F.col(b) - F.col("_mb"))).drop("_ma", "_mb"), f"{a}_x_{b}"


def centred_moments(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Moments of complete rows, centred at the column means (kept as ``mi``, ``mj``)."""
    d = df.na.drop(subset=list(cols))
    m = d.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    c = attach(d, m, []).select(*keys, *[(F.col(x) - F.col(f"_m_{x}")).alias(x) for x in cols])
    g = gram(c, keys, cols)
    arr = F.array(*[F.col(f"_m_{x}") for x in cols])
    return attach(g, m.select(arr.alias("_m")), [])


def _matrix(pdf: pd.DataFrame, p: int):
    """(1, x..) cross products (centred), n and the column means."""
    s = np.zeros((p + 1, p + 1))
    i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
    s[i + 1, j + 1] = s[j + 1, i + 1] = pdf["sij"]
    diag = pdf[pdf["i"] == pdf["j"]].set_index("i").sort_index()
    n = float(diag["n"].iloc[0])
    s[0, 0] = n
    s[0, 1:] = s[1:, 0] = diag["si"].to_numpy()
    return s, n, np.asarray(pdf["_m"].iloc[0], dtype=float)


def solve(s, n, means, y: int, xs: Sequence[int]):
    """Coefficients on the original scale, covariance factor, rss and total sum of squares."""
    ix = [0, *[x + 1 for x in xs]]
    a, b = s[np.ix_(ix, ix)], s[np.ix_(ix, [y + 1])][:, 0]
    inv = np.linalg.pinv(a, hermitian=True)
    beta = inv @ b
    rss = max(float(s[y + 1, y + 1] - b @ beta), 0.0)
    tss = float(s[y + 1, y + 1] - s[0, y + 1] ** 2 / n)
    t = np.eye(len(ix))
    t[0, 1:] = -means[list(xs)]
    raw = t @ beta
    raw[0] += means[y]
    return raw, t @ inv @ t.T, rss, tss


def _report(name, s, n, means, cols, y, xs):
    beta, inv, rss, tss = solve(s, n, means, cols.index(y), [cols.index(x) for x in xs])
    k = len(xs) + 1
    df = n - k
    sigma2 = rss / df if df > 0 else np.nan
    se = np.sqrt(np.maximum(np.diag(inv) * sigma2, 0.0))
    r2 = 1 - rss / tss if tss > 0 else np.nan
    with np.errstate(divide="ignore", invalid="ignore"):
        llf = -n / 2 * (np.log(2 * np.pi) + np.log(rss / n) + 1)
        t = np.where(se > 0, beta / se, np.nan)
    return pd.DataFrame({
        "model": name, "term": ["const", *xs], "beta": beta, "se": se, "t": t, "df": float(df), "n": int(n), "rss": rss, "r2": r2,
        "adj_r2": 1 - (1 - r2) * (n - 1) / df if df > 0 else np.nan, "aic": 2 * k - 2 * llf, "bic": k * np.log(n) - 2 * llf,
    })


def _grouped(g: DataFrame, keys: Sequence[str], fn, schema: str) -> DataFrame:
    keys = list(keys)
    src = g if keys else g.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    types = dict(g.dtypes)
    full = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def run(pdf):
        out = fn(pdf)
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return src.groupBy(*by).applyInPandas(run, (full + ", " if full else "") + schema)


def ols(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (), name: str = "ols") -> DataFrame:
    """P-30: least squares with an intercept: one row per term, with fit statistics."""
    return fit_models(df, {name: (y, list(xs))}, keys)


def fit_models(df: DataFrame, models: Mapping[str, tuple[str, Sequence[str]]], keys: Sequence[str] = ()) -> DataFrame:
    """P-30: several models on the same complete rows from one moment matrix."""
    cols = list(dict.fromkeys(c for y, xs in models.values() for c in (y, *xs)))
    g = centred_moments(df, keys, cols)
    spec = {n: (y, list(xs)) for n, (y, xs) in models.items()}

    def run(pdf):
        s, n, m = _matrix(pdf, len(cols))
        return pd.concat([_report(k, s, n, m, cols, y, xs) for k, (y, xs) in spec.items()])

    f = _grouped(g, keys, run, FIT)
    f = f.withColumn("p", t_p_value("t", F.when(F.col("df") > 0, F.col("df"))))
    q = t_quantile(F.lit(0.975), F.when(F.col("df") > 0, F.col("df")))
    return f.withColumn("_q", q).withColumn("ci_low", F.col("beta") - F.col("_q") * F.col("se")).withColumn("ci_high", F.col("beta") + F.col("_q") * F.col("se")).drop("_q")


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    d = df.na.drop(subset=list(cols))
    m = d.agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    j = attach(d, m, [])
    return j.select(*[F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def standardised_path(df: DataFrame, y: str, xs: Sequence[str], name: str = "path") -> DataFrame:
    """P-31: coefficients on z-scored variables, R squared."""
    return ols(cut(standardise(df, [y, *xs])), y, xs, name=name).where("term != 'const'")


def bootstrap_paths(df: DataFrame, unit: str, models: Mapping[str, tuple[str, Sequence[str]]], replicates: int, seed: int = 42) -> DataFrame:
    """Coefficients of every model in every bootstrap replicate (b, model, term, stat), from the replicate's moments."""
    cols = list(dict.fromkeys(c for y, xs in models.values() for c in (y, *xs)))
    d = cut(standardise(df, cols)).select(F.col(unit).alias("unit"), *cols)
    p = len(cols)
    pairs = [(i, k) for i in range(p) for k in range(i, p)]
    spec = {n: (y, list(xs)) for n, (y, xs) in models.items()}

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                s = np.zeros((p + 1, p + 1))
                s[0, 0] = r.n
                for i in range(p):
                    s[0, i + 1] = s[i + 1, 0] = getattr(r, f"s{i}")
                for i, k in pairs:
                    s[i + 1, k + 1] = s[k + 1, i + 1] = getattr(r, f"q{i}_{k}")
                for name, (y, xs) in spec.items():
                    beta, *_ = solve(s, r.n, np.zeros(p), cols.index(y), [cols.index(x) for x in xs])
                    rows += [(r.b, name, x, float(v)) for x, v in zip(xs, beta[1:])]
            yield pd.DataFrame(rows, columns=["b", "model", "term", "stat"])

    return replicate_moments(d, [], "unit", cols, replicates, seed).mapInPandas(run, "b int, model string, term string, stat double")


def indirect_effect(df: DataFrame, unit: str, x: str, m: str, y: str, replicates: int, seed: int = 42) -> DataFrame:
    """P-32: product of the paths x -> m and m -> y given x, with a bootstrap interval."""
    models = {"a": (m, [x]), "b": (y, [m, x])}
    r = bootstrap_paths(df, unit, models, replicates, seed)
    pick = lambda mod, t: F.max(F.when((F.col("model") == mod) & (F.col("term") == t), F.col("stat")))
    prod = r.groupBy("b").agg((pick("a", x) * pick("b", m)).alias("stat"))
    ci = percentile_ci(cut(prod), [])
    pt = fit_models(cut(standardise(df, [x, m, y])), models)
    est = pt.agg(
        F.max(F.when((F.col("model") == "a") & (F.col("term") == x), F.col("beta"))).alias("a"),
        F.max(F.when((F.col("model") == "b") & (F.col("term") == m), F.col("beta"))).alias("b"),
    ).withColumn("indirect", F.col("a") * F.col("b"))
    return attach(est, ci, [])


def composites(df: DataFrame, spec: Mapping[str, Mapping[str, float]], inverted: Sequence[str] = ()) -> DataFrame:
    """C-13: weighted mean of z-scored indicators (sample sd), inverted ones negated."""
    cols = list(dict.fromkeys(c for w in spec.values() for c in w))
    m = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    j = attach(df, m, [])
    z = {c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) * (-1.0 if c in inverted else 1.0) for c in cols}
    out = []
    for name, ws in spec.items():
        num = sum((F.coalesce(z[c] * w, F.lit(0.0)) for c, w in ws.items()), F.lit(0.0))
        den = sum((F.when(z[c].isNotNull(), F.lit(abs(w))).otherwise(0.0) for c, w in ws.items()), F.lit(0.0))
        out.append(F.try_divide(num, den).alias(name))
    return j.select(*df.columns, *out)


def composite_loadings(df: DataFrame, composite: str, indicators: Sequence[str]) -> DataFrame:
    """C-13: correlation of each indicator with its composite."""
    from .moments import pair_rows

    return pearson_by(pair_rows(df, [], [(i, composite) for i in indicators]), ["x", "y"], "vx", "vy", 3, "loading")


def vif(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """P-35: variance inflation, the diagonal of the inverse correlation matrix."""
    xs = list(xs)
    g = centred_moments(df, [], xs)

    def run(pdf):
        s, n, _ = _matrix(pdf, len(xs))
        c = s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:]) / n
        d = np.sqrt(np.diag(c))
        return pd.DataFrame({"term": xs, "vif": np.diag(np.linalg.pinv(c / np.outer(d, d)))})

    return _grouped(g, [], run, "term string, vif double")


def forward_stepwise(df: DataFrame, y: str, candidates: Sequence[str], criterion: str = "aic", enter_p: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    """P-36: add the best candidate while the criterion improves; all from one matrix.

    ``aic``: lowest AIC below the current one. ``p``: smallest p below ``enter_p``.
    """
    from .dist import t_sf2

    cols = [y, *candidates]
    g = centred_moments(df, keys, cols)

    def run(pdf):
        s, n, m = _matrix(pdf, len(cols))
        chosen, rows = [], []

        def rss_aic(xs):
            _b, _i, rss, tss = solve(s, n, m, 0, [cols.index(x) for x in xs])
            return rss, 2 * (len(xs) + 1) + n * (np.log(2 * np.pi) + np.log(max(rss, 1e-300) / n) + 1), tss

        cur = rss_aic([])[1]
        while len(chosen) < len(candidates):
            trial = []
            for c in candidates:
                if c in chosen:
                    continue
                rss, aic, tss = rss_aic([*chosen, c])
                rep = _report("s", s, n, m, cols, y, [*chosen, c]).iloc[-1]
                p = float(t_sf2(rep["t"], rep["df"])) if rep["df"] > 0 and rep["t"] == rep["t"] else 1.0
                trial.append((aic if criterion == "aic" else p, c, aic, p, 1 - rss / tss if tss > 0 else np.nan))
            best = min(trial)
            if (criterion == "aic" and best[0] >= cur) or (criterion == "p" and best[0] >= enter_p):
                break
            chosen.append(best[1])
            cur = best[2]
            rows.append((len(chosen), best[1], float(best[2]), float(best[3]), float(best[4])))
        return pd.DataFrame(rows, columns=["step", "term", "aic", "p", "r2"])

    return _grouped(g, keys, run, "step int, term string, aic double, p double, r2 double")


def repeated_kfold(df: DataFrame, unit: str, y: str, xs: Sequence[str], folds: int = 5, repeats: int = 10, seed: int = 42) -> DataFrame:
    """P-37: cross-validated R squared and RMSE.

    Moments per (repeat, fold) are reduced once; training moments are the total minus
    the fold, and the fold's squared error is a quadratic form in its own moments.
    """
    cols = [y, *xs]
    d = df.na.drop(subset=cols)
    m = d.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    d = attach(d, m, []).select(unit, *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in cols])
    r = d.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    r = r.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col("repeat"), F.col(unit)), F.lit(folds)))
    g = gram(r, ["repeat", "fold"], cols).withColumn("_m", F.array(*[F.lit(0.0)] * len(cols)))
    p = len(cols)

    def run(pdf):
        parts = {f: _matrix(x, p) for f, x in pdf.groupby("fold")}
        total = sum(s for s, _n, _m in parts.values())
        sse = sst = 0.0
        for s, n, mm in parts.values():
            tr = total - s
            beta, *_ = solve(tr, tr[0, 0], mm, 0, list(range(1, p)))
            ix = [0, *range(2, p + 1)]
            sse += s[1, 1] - 2 * beta @ s[ix, 1] + beta @ s[np.ix_(ix, ix)] @ beta
            mean = tr[0, 1] / tr[0, 0]
            sst += s[1, 1] - 2 * mean * s[0, 1] + mean * mean * n
        return pd.DataFrame({"r2": [1 - sse / sst if sst > 0 else np.nan], "rmse": [np.sqrt(max(sse, 0) / total[0, 0])]})

    f = _grouped(g, ["repeat"], run, "r2 double, rmse double")
    return f.agg(F.count("*").alias("n_repeats"), F.avg("r2").alias("cv_r2_mean"), F.stddev_samp("r2").alias("cv_r2_sd"), F.avg("rmse").alias("cv_rmse_mean"))


def residuals(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Rows with fitted value and residual; the coefficients travel as one row."""
    f = ols(df, y, xs)
    b = f.agg(*[F.max(F.when(F.col("term") == t, F.col("beta"))).alias(f"_b_{t}") for t in ["const", *xs]])
    d = attach(df.na.drop(subset=[y, *xs]), b, [])
    fit = F.col("_b_const") + sum((F.col(f"_b_{x}") * F.col(x) for x in xs), F.lit(0.0))
    return d.withColumn("fitted", fit).withColumn("resid", F.col(y) - fit).drop("_b_const", *[f"_b_{x}" for x in xs])


def diagnostics(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """P-38: correlation of ordered residuals with normal scores, and Breusch-Pagan."""
    r = cut(residuals(df, y, xs))
    k = average_rank(r, [], "resid", "_rk")
    k = with_group_aggs(k, [], _n=F.count("*"))
    k = k.withColumn("_z", normal_quantile((F.col("_rk") - 0.375) / (F.col("_n") + 0.25)))
    qq = pearson_by(k, [], "resid", "_z", 3, "qq_r")
    bp = ols(r.withColumn("_e2", F.col("resid") ** 2), "_e2", xs).agg((F.max("n") * F.max("r2")).alias("bp_lm"))
    return attach(qq, bp.withColumn("bp_p", chi2_p_value("bp_lm", F.lit(float(len(xs))))), [])


def cluster_robust(df: DataFrame, y: str, xs: Sequence[str], cluster: str) -> DataFrame:
    """P-34: standard errors from score sums per cluster (small-sample corrected)."""
    terms = ["const", *xs]
    r = cut(residuals(df, y, xs).withColumn("const", F.lit(1.0)))
    sc = r.groupBy(cluster).agg(*[F.sum(F.col(t) * F.col("resid")).alias(t) for t in terms])
    meat = gram(sc, [], terms).select(F.col("i"), F.col("j"), F.col("sij").alias("meat"), F.col("n").alias("g"))
    bread = gram(r, [], terms).select("i", "j", F.col("sij").alias("bread"), F.col("n").alias("n"))
    p = len(terms)

    def run(pdf):
        a, b = np.zeros((p, p)), np.zeros((p, p))
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        a[i, j] = a[j, i] = pdf["bread"]
        b[i, j] = b[j, i] = pdf["meat"]
        g, n = float(pdf["g"].iloc[0]), float(pdf["n"].iloc[0])
        inv = np.linalg.pinv(a, hermitian=True)
        v = inv @ b @ inv * (g / (g - 1)) * ((n - 1) / (n - p)) if g > 1 else np.full((p, p), np.nan)
        return pd.DataFrame({"term": terms, "se_cluster": np.sqrt(np.maximum(np.diag(v), 0)), "n_clusters": int(g)})

    se = _grouped(meat.join(bread, ["i", "j"]), [], run, "term string, se_cluster double, n_clusters long")
    return ols(df, y, xs).select("term", "beta").join(se, "term")


def nested_rss(df: DataFrame, y: str, blocks: Mapping[str, Sequence[str]], covariates: Sequence[str] = ()) -> DataFrame:
    """P-41: type II sums of squares of term blocks (an interaction is a block "a:b").

    Every block is tested against the model holding all blocks that do not contain it.
    """
    blocks = {k: list(v) for k, v in blocks.items()}
    cols = [y, *covariates, *[c for v in blocks.values() for c in v]]
    g = centred_moments(df, [], cols)
    base = list(covariates)

    def run(pdf):
        s, n, m = _matrix(pdf, len(cols))
        fit = lambda names: solve(s, n, m, 0, [cols.index(c) for c in [*base, *[x for b in names for x in blocks[b]]]])[2]
        full = fit(blocks)
        dfe = n - 1 - len(cols) + 1
        rows = []
        for b in blocks:
            contains = lambda o: set(b.split(":")) < set(o.split(":"))
            others = [o for o in blocks if o != b and not contains(o)]
            ss, d1 = fit(others) - fit([*others, b]), len(blocks[b])
            rows.append((b, ss, float(d1), full, float(dfe), (ss / d1) / (full / dfe) if dfe > 0 and full > 0 else np.nan, ss / (ss + full) if ss + full > 0 else np.nan))
        return pd.DataFrame(rows, columns=["term", "ss", "df", "ss_resid", "df_resid", "f", "partial_eta2"])

    a = _grouped(g, [], run, "term string, ss double, df double, ss_resid double, df_resid double, f double, partial_eta2 double")
    return a.withColumn("p", f_p_value("f", "df", "df_resid"))


def two_factor_anova(df: DataFrame, y: str, a: str, b: str, levels_a: Sequence[str], levels_b: Sequence[str], covariates: Sequence[str] = (), interaction: bool = True) -> DataFrame:
    """P-41: two factors with or without interaction, optionally with covariates (ANCOVA)."""
    d, na = dummies(df, a, levels_a)
    d, nb = dummies(d, b, levels_b)
    blocks = {a: na, b: nb}
    if interaction:
        # Sum-to-zero products keep the interaction apart from the main effects.
        names = []
        for x in na:
            for z in nb:
                d = d.withColumn(f"{x}_x_{z}", (F.col(x) - 1.0 / len(levels_a)) * (F.col(z) - 1.0 / len(levels_b)))
                names.append(f"{x}_x_{z}")
        blocks[f"{a}:{b}"] = names
    return nested_rss(d, y, blocks, covariates)


def adjusted_means(df: DataFrame, y: str, factor: str, levels: Sequence[str], covariates: Sequence[str]) -> DataFrame:
    """P-41: mean of each level at the average of the covariates."""
    d, names = dummies(df, factor, levels)
    f = ols(d, y, [*names, *covariates])
    m = d.na.drop(subset=[y, *names, *covariates]).agg(*[F.avg(c).alias(f"_m_{c}") for c in covariates])
    b = f.agg(*[F.max(F.when(F.col("term") == t, F.col("beta"))).alias(f"_b_{t}") for t in ["const", *names, *covariates]])
    base = F.col("_b_const") + sum((F.col(f"_b_{c}") * F.col(f"_m_{c}") for c in covariates), F.lit(0.0))
    rows = [F.struct(F.lit(levels[0]).alias("level"), base.alias("adjusted_mean"))]
    rows += [F.struct(F.lit(lv).alias("level"), (base + F.col(f"_b_{n}")).alias("adjusted_mean")) for lv, n in zip(levels[1:], names)]
    return attach(b, m, []).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def dispersion_regression(df: DataFrame, group: str, score: str, outcome: DataFrame, y: str) -> DataFrame:
    """P-43: outcome on the group mean, and on mean and sd; gain in R squared.

    Mean and sd that move together (|r| > 0.7) are flagged.
    """
    g = df.groupBy(group).agg(F.avg(score).alias("m"), F.stddev_samp(score).alias("sd")).join(outcome, group)
    g = cut(standardise(g, ["m", "sd", y]))
    f = fit_models(g, {"mean": (y, ["m"]), "mean_sd": (y, ["m", "sd"])})
    pick = lambda mod, c: F.max(F.when(F.col("model") == mod, F.col(c)))
    s = f.agg(
        F.max("n").alias("n"), pick("mean", "r2").alias("r2_mean"), pick("mean_sd", "r2").alias("r2_mean_sd"),
        F.max(F.when((F.col("model") == "mean_sd") & (F.col("term") == "sd"), F.col("beta"))).alias("beta_sd"),
    )
    r = pearson_by(g, [], "m", "sd", 3, "r_mean_sd").drop("n")
    s = attach(s, r, [])
    return s.withColumn("delta_r2", F.col("r2_mean_sd") - F.col("r2_mean")).withColumn("confounded", F.abs("r_mean_sd") > 0.7)


def random_intercept(df: DataFrame, group: str, y: str, x: str) -> DataFrame:
    """P-44: slope of x with a random intercept per group: moment estimates, then GLS.

    Variances come from the one-way moments of the least-squares residuals; the GLS fit is
    least squares after subtracting theta times the group mean from every variable.
    """
    from .reliability import variance_components

    r = cut(residuals(df, y, [x]))
    vc = variance_components(r, group, "resid").select("var_between", "var_within")
    d = with_group_aggs(r, [group], _n=F.count("*"), _my=F.avg(y), _mx=F.avg(x))
    d = attach(d, vc, [])
    th = 1.0 - F.sqrt(F.col("var_within") / (F.col("var_within") + F.col("_n") * F.col("var_between")))
    d = d.withColumn("_t", th)
    yy, xx, c = F.col(y) - F.col("_t") * F.col("_my"), F.col(x) - F.col("_t") * F.col("_mx"), 1.0 - F.col("_t")
    s = d.agg(
        F.sum(c * c).alias("cc"), F.sum(c * xx).alias("cx"), F.sum(xx * xx).alias("xx"), F.sum(c * yy).alias("cy"), F.sum(xx * yy).alias("xy"),
        F.max("var_between").alias("var_between"), F.max("var_within").alias("var_within"), F.count("*").alias("n"),
    )
    det = F.col("cc") * F.col("xx") - F.col("cx") * F.col("cx")
    return s.select(
        "n", "var_between", "var_within", ((F.col("xx") * F.col("cy") - F.col("cx") * F.col("xy")) / det).alias("intercept"),
        ((F.col("cc") * F.col("xy") - F.col("cx") * F.col("cy")) / det).alias("slope"),
        F.sqrt(F.col("var_within") * F.col("cc") / det).alias("se_slope"),
    )
