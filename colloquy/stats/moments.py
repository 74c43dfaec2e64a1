"""Correlations from sums (P-01 to P-03) and shared moment matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from colloquy.operators.scan import average_rank, attach


def pearson_by(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 2, out: str = "r") -> DataFrame:
    """P-01: correlation over complete pairs; NULL for a constant side, never an error.

    Built from mergeable aggregates, so partial sums are formed before the shuffle.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    g = df.groupBy(*keys).agg(
        F.count(F.when(both, F.lit(1))).alias("n"), F.covar_pop(a, b).alias("_c"),
        F.stddev_pop(a).alias("_sa"), F.stddev_pop(b).alias("_sb"), F.avg(F.abs(a)).alias("_ma"), F.avg(F.abs(b)).alias("_mb"),
    )
    # A spread at rounding level of the values counts as constant.
    ok = (F.col("n") >= min_n) & (F.col("_sa") > 1e-12 * F.col("_ma")) & (F.col("_sb") > 1e-12 * F.col("_mb"))
    r = F.try_divide(F.col("_c"), F.col("_sa") * F.col("_sb"))
    r = F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))
    return g.select(*keys, "n", F.when(ok, r).alias(out))


def spearman_by(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 3, out: str = "rho") -> DataFrame:
    """P-02: rank correlation with averaged ties, ranks taken over complete pairs."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    d = average_rank(d, keys, x, "_rx")
    d = average_rank(d, keys, y, "_ry")
    return pearson_by(d, keys, "_rx", "_ry", min_n, out)


def pair_rows(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Requested column pairs as rows ``x, y, vx, vy`` (the list is the caller's)."""
    arr = F.array(
        *[
            F.struct(
                F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).cast("double").alias("vx"), F.col(b).cast("double").alias("vy")
            )
            for a, b in pairs
        ]
    )
    return df.select(*keys, F.explode(arr).alias("_p")).select(*keys, "_p.*")


def combinations(cols: Sequence[str]) -> list[tuple[str, str]]:
    """J-15: unordered pairs of distinct features."""
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def gram(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete moments of every column pair: one p x p block per input batch.

    Rows ``keys, i, j, n, si, sj, sii, sjj, sij`` for i <= j, where sums run over rows
    with both values. Each task reduces its rows to one block per key before the
    shuffle, so the exchange does not grow with the number of rows.
    """
    keys, cols = list(keys), list(cols)
    p = len(cols)
    iu = np.triu_indices(p)
    schema = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    schema = (schema + ", " if keys else "") + "i int, j int, n double, si double, sj double, sii double, sjj double, sij double"

    def block(m):
        w = ~np.isnan(m)
        z = np.where(w, m, 0.0)
        w = w.astype(float)
        n, s, q, c = w.T @ w, z.T @ w, (z * z).T @ w, z.T @ z
        return pd.DataFrame({
            "i": iu[0], "j": iu[1], "n": n[iu], "si": s[iu], "sj": s.T[iu], "sii": q[iu], "sjj": q.T[iu], "sij": c[iu],
        })

    def partial(batches):
        acc = {}
        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            for key, g in groups:
                b = block(g[cols].to_numpy(dtype=float))
                key = key if isinstance(key, tuple) else (key,)
                if key in acc:
                    acc[key].iloc[:, 2:] += b.iloc[:, 2:]
                else:
                    acc[key] = b
            if len(acc) > 4096:  # many keys: hand over and start again
                yield from _emit(acc)
                acc = {}
        yield from _emit(acc)

    def _emit(acc):
        for key, b in acc.items():
            b = b.copy()
            for name, v in zip(reversed(keys), reversed(key)):
                b.insert(0, name, v)
            yield b

    src = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    part = src.mapInPandas(partial, schema)
    sums = ["n", "si", "sj", "sii", "sjj", "sij"]
    return part.groupBy(*keys, "i", "j").agg(*[F.sum(c).alias(c) for c in sums])


def correlation_matrix(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """P-03: all Pearson pairs at once from centred moment blocks (``x < y`` by position)."""
    cols = list(cols)
    # Centre first: correlations do not depend on the shift, rounding does.
    mean = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    c = attach(df, mean, []).select(*keys, *[(F.col(x) - F.col(f"_m_{x}")).alias(x) for x in cols])
    g = gram(c, keys, cols).where("i < j")
    cov = F.col("sij") - F.col("si") * F.col("sj") / F.col("n")
    va = F.col("sii") - F.col("si") * F.col("si") / F.col("n")
    vb = F.col("sjj") - F.col("sj") * F.col("sj") / F.col("n")
    ok = (F.col("n") >= 2) & (va > 1e-20 * F.col("sii")) & (vb > 1e-20 * F.col("sjj"))
    names = F.array(*[F.lit(x) for x in cols])
    return g.select(
        *keys, names[F.col("i")].alias("x"), names[F.col("j")].alias("y"), F.col("n").cast("long").alias("n"),
        F.when(ok, F.try_divide(cov, F.sqrt(va) * F.sqrt(vb))).alias("r"),
    )


def spearman_matrix(df: DataFrame, cols: Sequence[str], id_col: str) -> DataFrame:
    """P-03: Spearman of all pairs, ranks recomputed on each pair's complete rows."""
    return spearman_by(pair_rows(df, [id_col], combinations(cols)), ["x", "y"], "vx", "vy")
