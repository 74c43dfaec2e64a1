"""Resampling inference on long pair tables (P-05 to P-12).

Input rows are ``keys, unit, x, y``. A replicate is never a copy of the rows: a unit's count in a replicate is a
seeded draw of (seed, replicate, unit), Poisson with mean 1, that every task makes for its own rows in place. Tasks
reduce their rows to sums per replicate, so results do not depend on partitioning and exchanges hold sums, or for rank
statistics one vector of ranks for each row and block of replicates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.operators.scan import (
    average_rank, cumulative_counts, join_keys, places, previous_max, quantiles, ranges, row_number, running_sum, attach, scan,
    with_group_aggs,
)
from colloquy.session import cut
from .dist import correlation_p, normal_cdf, normal_quantile
from .draws import counts, permuted, unit_number
from .moments import pearson_by, spearman_by

CHUNK_ROWS = 1 << 14
BLOCK = 64  # replicates that a task holds for a chunk of rows at once
DEALT = 1 << 22  # draws that a task makes where groups are dealt out by work
HELD = 1 << 23  # sums a task keeps before it hands them over
PIECES = 32


def bh_fdr(df: DataFrame, family: Sequence[str], p: str = "p", out: str = "p_fdr") -> DataFrame:
    """P-05: Benjamini-Hochberg adjusted p within each family; missing p stays missing.

    adjusted(i) = min over j >= i of p(j) * m / j. The running rank and the minimum from above are scans over ranges of
    (family, p), so neither a large family nor many equal p fall to one task.
    """
    fam = list(family)
    d = df.withColumn("_i", F.xxhash64(*[F.col(c) for c in df.columns]))
    ok = ranges(d.where(F.col(p).isNotNull()), [*fam, p, "_i"])
    m = ok.groupBy(*fam).agg(F.count("*").alias("_m"))
    r = scan(ok, fam, [p, "_i"], F.col("_range"), {"_k": row_number()})
    r = attach(r, m, fam, "inner").withColumn("_q", -F.col(p) * F.col("_m") / F.col("_k")).withColumn("_down", -F.col("_k"))
    # From the largest p downwards the adjusted value is the running minimum.
    s = scan(cut(r), fam, ["_down"], -F.col("_range"), {"_best": previous_max("_q")})
    s = s.withColumn(out, F.least(-F.greatest("_q", "_best"), F.lit(1.0)))
    rest = df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    return s.select(*df.columns, out).unionByName(rest)


def _schema(df: DataFrame, keys: Sequence[str], rest: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([*[f"`{k}` {types[k]}" for k in keys], rest])


def moment_names(p: int) -> list[str]:
    return ["n", *[f"s{i}" for i in range(p)], *[f"q{i}_{j}" for i in range(p) for j in range(i, p)]]


def replicate_moments(df: DataFrame, keys: Sequence[str], unit: str, cols: Sequence[str], replicates: int, seed: int = 42) -> DataFrame:
    """Sums of every bootstrap replicate: ``keys, b``, n, s{i} (sum of column i) and q{i}_{j} (of products), i <= j.

    Complete rows count. They stay where they are: a batch of rows becomes, by one product of matrices, its sums in all
    replicates, and only these are exchanged.
    """
    keys, cols = list(keys), list(cols)
    p, q = len(cols), 1 + len(cols) + len(cols) * (len(cols) + 1) // 2
    src = df.na.drop(subset=cols).select(*keys, unit_number(df, unit).alias("_u"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    block, held = BLOCK, HELD

    def sums(pdf, into):
        z = pdf[[f"_{i}" for i in range(p)]].to_numpy(float)
        terms = np.column_stack([np.ones(len(z)), z, *[z[:, i] * z[:, j] for i in range(p) for j in range(i, p)]])
        unit_ = pdf["_u"].to_numpy()
        for lo in range(0, replicates, block):
            b = np.arange(lo, min(lo + block, replicates))
            into[b] += counts(unit_, b, seed).astype(float).T @ terms

    def rows(acc):
        for key, m in acc.items():
            out = pd.DataFrame({"b": np.arange(replicates), "m": list(m)})
            for k, v in zip(reversed(keys), reversed(key)):
                out.insert(0, k, v)
            yield out

    def run(batches):
        acc = {}
        for pdf in batches:
            for key, g in (pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]):
                sums(g, acc.setdefault(key, np.zeros((replicates, q))))
                if len(acc) * replicates * q > held:
                    yield from rows(acc)
                    acc = {}
        yield from rows(acc)

    part = src.mapInPandas(run, _schema(df, keys, "b int, m array<double>"))
    return part.groupBy(*keys, "b").agg(*[F.sum(F.col("m")[i]).alias(n) for i, n in enumerate(moment_names(p))])


def _correlations_from_moments(m: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    n = F.col("n")
    vx, vy = F.col("q0_0") - F.col("s0") * F.col("s0") / n, F.col("q1_1") - F.col("s1") * F.col("s1") / n
    c = F.col("q0_1") - F.col("s0") * F.col("s1") / n
    ok = (n > 1) & (vx > 1e-12 * F.col("q0_0")) & (vy > 1e-12 * F.col("q1_1"))
    return m.select(*keys, F.when(ok, F.try_divide(c, F.sqrt(F.when(vx > 0, vx)) * F.sqrt(F.when(vy > 0, vy)))).alias(out))


def _complete(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Complete pairs with the unit as a number."""
    d = df.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return d.select(*keys, unit_number(df, "unit").alias("_u"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def _prefix(w: np.ndarray) -> np.ndarray:
    """Sums over the first 0, 1, ... rows."""
    return np.vstack([np.zeros((1, w.shape[1]), np.int64), np.cumsum(w, axis=0, dtype=np.int64)])


def _pack(m) -> bytes:
    return np.ascontiguousarray(m, np.int64).tobytes()


def _unpack(b) -> np.ndarray:
    return np.frombuffer(b, np.int64)


def dealt(df: DataFrame, group: Sequence[str], draws: int) -> DataFrame:
    """Groups dealt over tasks by their draws: they are small in bytes, so adaptive execution would merge them into few tasks."""
    return df.repartition(max(1, -(-draws // DEALT)), *group)


def _chunked(d: DataFrame, keys: list[str], value: str, rows: int) -> DataFrame:
    """Rows in order of a value, cut into chunks ``_c{value}`` of at most ``rows``."""
    chunk = (F.shiftleft(F.col("_range").cast("long"), 40) + F.expr(f"_at div {rows}")).alias(f"_c{value}")
    return ranges(d, [*keys, value, "_u"]).select(*d.columns, chunk)


def _runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each row's equal values in a sorted column, and the place behind the last."""
    return np.searchsorted(v, v, "left"), np.searchsorted(v, v, "right")


def _replicate_rank_carry(d: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """What a chunk must know of the others, for each side and block of replicates.

    ``base``: counts before the chunk; ``lo``: counts before the equal values that reach in from the left; ``hi``: counts
    up to the end of the equal values that reach out to the right; ``n``: all counts.
    """
    block = BLOCK
    side = lambda s: d.select(*keys, F.lit(s).alias("_side"), F.col(f"_c{s}").alias("_c"), F.col(s).alias("v"), "_u")
    group = [*keys, "_side", "_c"]

    def totals(pdf):
        pdf = pdf.sort_values(["v", "_u"])
        v, unit = pdf["v"].to_numpy(), pdf["_u"].to_numpy()
        first_end, last_start = np.searchsorted(v, v[0], "right"), np.searchsorted(v, v[-1], "left")
        out = []
        for k, lo in enumerate(range(0, replicates, block)):
            c0 = _prefix(counts(unit, np.arange(lo, min(lo + block, replicates)), seed))
            out.append((*pdf[group].iloc[0], k, v[0], v[-1], _pack(c0[-1]), _pack(c0[last_start]), _pack(c0[first_end])))
        return pd.DataFrame(out, columns=[*group, "_k", "first", "last", "total", "opens", "closes"])

    kinds = _schema(d, keys, "_side string, _c long, _k int")
    t = dealt(side("x").unionByName(side("y")), group, 2 * d.count() * replicates).groupBy(*group).applyInPandas(totals, kinds + ", first double, last double, total binary, opens binary, closes binary")

    def carry(pdf):
        pdf = pdf.sort_values("_c").reset_index(drop=True)
        base = _prefix(np.stack([_unpack(b) for b in pdf["total"]]))
        first, last, n = pdf["first"].to_numpy(), pdf["last"].to_numpy(), len(pdf)
        lo, hi = [None] * n, [None] * n
        for i in range(n):
            if i and first[i] == last[i - 1]:
                lo[i] = start
            if lo[i] is None or first[i] != last[i]:
                start = _pack(base[i] + _unpack(pdf["opens"].iloc[i]))
        for i in range(n - 1, -1, -1):
            if i + 1 < n and last[i] == first[i + 1]:
                hi[i] = end
            if hi[i] is None or first[i] != last[i]:
                end = _pack(base[i] + _unpack(pdf["closes"].iloc[i]))
        out = pdf[[*group, "_k"]].copy()
        out["base"], out["lo"], out["hi"], out["n"] = [_pack(b) for b in base[:-1]], lo, hi, [_pack(base[-1])] * n
        return out

    return cut(t.groupBy(*keys, "_side", "_k").applyInPandas(carry, kinds + ", base binary, lo binary, hi binary, n binary"))


def _bootstrap_spearman(df: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """Rank correlation of every replicate, with the ranks of the replicate itself.

    A value's rank follows from the counts before and up to its equal values. Rows are cut into chunks in order of x and
    of y; a chunk sums its counts, the sums are carried over the chunks, and each chunk's rows get their ranks by x in
    all replicates of a block. These vectors go once to the chunks in order of y, which reduce them to sums.
    """
    d = _chunked(_chunked(_complete(df, keys), keys, "x", CHUNK_ROWS), keys, "y", CHUNK_ROWS)
    carry = _replicate_rank_carry(d, keys, replicates, seed)
    block = BLOCK

    def ranks(pdf, known):
        """Counts of the block, and twice the rank of each row less its mean."""
        pdf = pdf.sort_values(["v", "_u"])
        c, v = known.iloc[0], pdf["v"].to_numpy()
        lo = int(c["_k"]) * block
        w = counts(pdf["_u"].to_numpy(), np.arange(lo, min(lo + block, replicates)), seed)
        c0, (f, l) = _prefix(w) + _unpack(c["base"]), _runs(v)
        low, high = c0[f], c0[l]
        if c["lo"] is not None:
            low = np.where((v == v[0])[:, None], _unpack(c["lo"]), low)
        if c["hi"] is not None:
            high = np.where((v == v[-1])[:, None], _unpack(c["hi"]), high)
        return pdf, w, low + high - _unpack(c["n"]), lo

    def by_x(pdf, known):
        pdf, _w, v, _lo = ranks(pdf, known)
        out = pdf[[*keys, "_k", "_u", "y", "_cy"]].copy()
        out["r"] = [_pack(r) for r in v]
        return out

    def by_y(pdf, known):
        pdf, w, v, lo = ranks(pdf, known)
        w, v, u = w.astype(float), v.astype(float), np.stack([_unpack(b) for b in pdf["r"]]).astype(float)
        out = pd.DataFrame({"b": lo + np.arange(w.shape[1]), "sxy": (w * u * v).sum(0), "sxx": (w * u * u).sum(0), "syy": (w * v * v).sum(0)})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    blocks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // block))).alias("_k")
    group = [*keys, "_c", "_k"]
    draws = d.count() * replicates
    known = lambda s: carry.where(F.col("_side") == s).drop("_side").groupBy(*group)
    r = d.select(*keys, "_u", F.col("x").alias("v"), "y", "_cy", F.col("_cx").alias("_c"), blocks)
    r = dealt(r, group, draws).groupBy(*group).cogroup(known("x")).applyInPandas(by_x, _schema(d, keys, "_k int, _u long, y double, _cy long, r binary"))
    r = r.select(*keys, "_k", "_u", F.col("y").alias("v"), "r", F.col("_cy").alias("_c"))
    s = dealt(r, group, draws).groupBy(*group).cogroup(known("y")).applyInPandas(by_y, _schema(d, keys, "b int, sxy double, sxx double, syy double"))
    g = s.groupBy(*keys, "b").agg(*[F.sum(c).alias(c) for c in ("sxy", "sxx", "syy")])
    return g.select(*keys, "b", F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx")) * F.sqrt(F.col("syy"))).alias("stat"))


def bootstrap_correlations(
    df: DataFrame, keys: Sequence[str], replicates: int, method: str = "spearman", seed: int = 42
) -> DataFrame:
    """P-06: the correlation of every replicate, ``keys, b, stat``; ranks are redone per replicate."""
    keys = list(keys)
    if method == "spearman":
        return _bootstrap_spearman(df, keys, replicates, seed)
    d = with_group_aggs(df.where(F.col("x").isNotNull() & F.col("y").isNotNull()), keys, _mx=F.avg("x"), _my=F.avg("y"))
    d = d.select(*keys, "unit", (F.col("x") - F.col("_mx")).alias("x"), (F.col("y") - F.col("_my")).alias("y"))
    return _correlations_from_moments(replicate_moments(d, keys, "unit", ["x", "y"], replicates, seed), [*keys, "b"], "stat")


def _pieces(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    cuts = [i / PIECES for i in range(1, PIECES)]
    b = df.groupBy(*keys).agg(F.percentile_approx(value, cuts, 1000).alias("_b"))
    j = attach(df, b, keys)
    return j.withColumn(out, F.size(F.filter("_b", lambda v: v <= F.col(value)))).drop("_b")


def percentile_ci(reps: DataFrame, keys: Sequence[str], level: float = 0.95) -> DataFrame:
    """P-06: percentile interval of the replicate statistics."""
    a = (1 - level) / 2
    return quantiles(reps, keys, "stat", {"ci_low": a, "ci_high": 1 - a})


def jackknife(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P-10 (Pearson): the correlation without each unit, from the totals minus its row."""
    keys = list(keys)
    d = df.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, "unit", "x", "y")
    d = with_group_aggs(d, keys, _mx=F.avg("x"), _my=F.avg("y"))
    d = d.withColumn("x", F.col("x") - F.col("_mx")).withColumn("y", F.col("y") - F.col("_my")).drop("_mx", "_my")
    x, y = F.col("x"), F.col("y")
    d = with_group_aggs(d, keys, n=F.count("*"), sx=F.sum(x), sy=F.sum(y), sxx=F.sum(x * x), syy=F.sum(y * y), sxy=F.sum(x * y))
    n = F.col("n") - 1
    sx, sy = F.col("sx") - x, F.col("sy") - y
    vx = F.col("sxx") - x * x - sx * sx / n
    vy = F.col("syy") - y * y - sy * sy / n
    c = F.col("sxy") - x * y - sx * sy / n
    return d.where("n > 2").select(*keys, "unit", F.try_divide(c, F.sqrt(F.when(vx > 0, vx)) * F.sqrt(F.when(vy > 0, vy))).alias("stat"))


def leave_one_out_spearman(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P-10: the rank correlation without each unit, without building unit pairs.

    Taking unit u away lowers the rank of every larger value by 1 and of every equal
    value by 1/2. The new sums follow from running sums of ranks, and the joint term
    (units above u on both sides) from a count per bit of the x position: at each bit,
    u's block meets its upper sibling, and counts of larger y are running counts there.
    """
    keys = list(keys)
    d = df.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        *keys, "unit", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")
    )
    d = cut(average_rank(cut(average_rank(d, keys, "x", "rx")), keys, "y", "ry"))
    d = with_group_aggs(d, keys, n=F.count("*"), sxy=F.sum(F.col("rx") * F.col("ry")), sxx=F.sum(F.col("rx") ** 2), syy=F.sum(F.col("ry") ** 2))
    d = cut(_pieces(_pieces(d, keys, "x", "_px"), keys, "y", "_py"))

    def above(val: str, other: str, piece: str, tag: str) -> DataFrame:
        """Sums of own and other rank over units above, and at, each value of ``val``."""
        g = d.groupBy(*keys, val, piece).agg(F.count("*").alias("_k"), F.sum(f"r{val}").alias("_so"), F.sum(f"r{other}").alias("_st"))
        g = g.withColumn("_neg", -F.col(val)).withColumn("_np", -F.col(piece).cast("long"))
        s = scan(g, keys, ["_neg"], F.col("_np"), {"_ck": running_sum("_k"), "_co": running_sum("_so"), "_ct": running_sum("_st")})
        half = lambda c, e: F.col(c) - F.col(e) + F.col(e) / 2.0
        return s.select(
            *keys, val, F.col("_k").alias(f"_eq{tag}"), (F.col("_ck") - F.col("_k")).alias(f"_gt{tag}"),
            half("_co", "_so").alias(f"_own{tag}"), half("_ct", "_st").alias(f"_oth{tag}"),
        )

    e = d.join(above("x", "y", "_px", "a"), [*keys, "x"]).join(above("y", "x", "_py", "b"), [*keys, "y"])
    # Joint counts. Position of the distinct x values in order (equal values share one).
    pos = scan(d.select(*keys, "x", "_px").distinct(), keys, ["x"], F.col("_px").cast("long"), {"_pos": row_number()})
    p = cut(d.join(pos.select(*keys, "x", "_pos"), [*keys, "x"]).select(*keys, "unit", "x", "y", "_py", "_pos"))
    # As many levels as the largest position of the group has bits.
    top = p.groupBy(*keys).agg(F.max("_pos").alias("_mp"))
    lv = attach(p, top, keys).where("_mp > 0")
    lv = lv.withColumn("_lv", F.explode(F.sequence(F.lit(0), F.length(F.bin("_mp")) - 1))).drop("_mp")
    # Past the highest set bit all positions share one block without an upper sibling.
    lv = lv.withColumn("_blk", F.expr("shiftright(_pos, _lv + 1)")).withColumn("_up", F.expr("shiftright(_pos, _lv) & 1"))
    lv = cut(lv)
    cnt = lv.groupBy(*keys, "_lv", "_blk", "_py", "y").agg(F.sum("_up").alias("_u"))
    cnt = cnt.withColumn("_neg", -F.col("y"))
    run = scan(cnt, [*keys, "_lv", "_blk"], ["_neg"], -F.col("_py").cast("long"), {"_cu": running_sum("_u")})
    run = run.withColumn("_gt", F.col("_cu") - F.col("_u")).select(*keys, "_lv", "_blk", "y", "_gt", "_u")
    j = lv.where("_up = 0").join(run, [*keys, "_lv", "_blk", "y"])
    joint = j.groupBy(*keys, "unit").agg(F.sum(F.col("_gt") + F.col("_u") / 2.0).alias("_joint"))
    # Equal x: half weight for larger y, a quarter for equal y (not u itself).
    sx = d.groupBy(*keys, "x", "_py", "y").agg(F.count("*").alias("_k")).withColumn("_neg", -F.col("y"))
    sx = scan(sx, [*keys, "x"], ["_neg"], -F.col("_py").cast("long"), {"_ck": running_sum("_k")})
    same = sx.select(*keys, "x", "y", ((F.col("_ck") - F.col("_k")) / 2.0 + (F.col("_k") - 1) / 4.0).alias("_same"))
    e = e.join(joint, [*keys, "unit"], "left").na.fill(0.0, ["_joint"]).join(same, [*keys, "x", "y"])
    n = F.col("n") - 1
    # Sums without u; own rows at u's value contribute half, u itself must not.
    sxy = F.col("sxy") - F.col("rx") * F.col("ry")
    adj = (F.col("_otha") - F.col("ry") / 2.0) + (F.col("_othb") - F.col("rx") / 2.0)
    sxy = sxy - adj + F.col("_joint") + F.col("_same")

    def squares(s, own, gt, eq, r):
        q = F.col(gt) + (F.col(eq) - 1) / 4.0
        return F.col(s) - F.col(r) ** 2 - 2.0 * (F.col(own) - F.col(r) / 2.0) + q

    sxx = squares("sxx", "_owna", "_gta", "_eqa", "rx")
    syy = squares("syy", "_ownb", "_gtb", "_eqb", "ry")
    mean2 = n * (n + 1) * (n + 1) / 4.0
    vx, vy = sxx - mean2, syy - mean2
    rho = F.when((vx > 1e-9) & (vy > 1e-9), (sxy - mean2) / F.sqrt(F.when(vx > 0, vx)) / F.sqrt(F.when(vy > 0, vy)))
    return e.where(n >= 3).select(*keys, "unit", rho.alias("stat"))


def leave_one_out_range(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P-10: smallest and largest correlation when any one unit is removed, and the unit of the strongest (of equals the smallest)."""
    return leave_one_out_spearman(df, keys).groupBy(*keys).agg(
        F.min("stat").alias("loo_min"), F.max("stat").alias("loo_max"),
        F.min_by("unit", F.when(F.col("stat").isNotNull(), F.struct(-F.abs("stat"), F.col("unit")))).alias("loo_unit"),
    )


def minimal_removal(df: DataFrame, keys: Sequence[str], threshold: float = 0.70, max_remove: int = 4) -> DataFrame:
    """P-11: units to take away until the rank correlation falls below ``threshold``: ``keys, k, unit, rho_after, reached``.

    Greedy: each step removes the unit without which the correlation is lowest (of equals the smallest unit), by one
    leave-one-out pass over all keys that are still above the threshold. One step is exact; with more steps another set
    of the same or a smaller number may exist, which only a search over all subsets could find. ``reached`` is false for
    keys that stay above after ``max_remove`` steps or when fewer than four units are left.
    """
    keys = list(keys)
    left = cut(_with_unit(df, keys))
    out = None
    for k in range(1, max_remove + 1):
        loo = leave_one_out_spearman(left, keys).where(F.col("stat").isNotNull())
        step = loo.groupBy(*keys).agg(F.min(F.struct("stat", "unit")).alias("_m"))
        step = step if keys else step.where("_m is not null")
        step = cut(step.select(*keys, F.lit(k).alias("k"), F.col("_m.unit").alias("unit"), F.col("_m.stat").alias("rho_after"), (F.col("_m.stat") < threshold).alias("reached")))
        out = step if out is None else out.unionByName(step)
        open_ = step.where(~F.col("reached")).select(*keys, F.col("unit").alias("_gone"))
        if open_.isEmpty():
            break
        left = cut(attach(left, open_, keys, "inner").where(F.col("unit") != F.col("_gone")).drop("_gone"))
    return out


def _with_unit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, "unit", "x", "y")


def permutation_correlations(df: DataFrame, keys: Sequence[str], replicates: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """P-08: rank correlation (``keys, rho, n``), and that of every random re-pairing (``keys, b, stat``).

    Ranks do not change under permutation, so they are computed once. Replicate b pairs the y of the row at place i by x
    with the x at place pi_b(i), where pi_b is computed from (seed, b, i) alone. A chunk of places pairs what stays inside
    it on the spot and sends the rest, packed, to the chunks of their new places.
    """
    keys = list(keys)
    d = average_rank(average_rank(_complete(df, keys), keys, "x", "_rx"), keys, "y", "_ry")
    d = with_group_aggs(places(ranges(d, [*keys, "x", "_u"]), keys, "px"), keys, _n=F.count("*"))
    centred = lambda c: 2.0 * F.col(c) - F.col("_n") - 1
    d = cut(d.select(*keys, "px", "_n", centred("_rx").alias("x"), centred("_ry").alias("y")))
    scale = d.groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("_xy"), F.sum(F.col("x") * F.col("x")).alias("_xx"), F.sum(F.col("y") * F.col("y")).alias("_yy"), F.count("*").alias("n"))
    root = F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy"))
    rows, block = 4 * CHUNK_ROWS, max(1, BLOCK // 4)
    cell = np.dtype([("b", "<u2"), ("at", "<u2" if rows <= 1 << 16 else "<u4"), ("y", "<f8")])

    def pair(pdf):
        pdf = pdf.sort_values("px")
        c, k, n = int(pdf["_c"].iloc[0]), int(pdf["_k"].iloc[0]), int(pdf["_n"].iloc[0])
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        b = np.arange(k * block, min((k + 1) * block, replicates))
        to = permuted(pdf["px"].to_numpy(), n, b, seed)
        near = to // rows == c
        met = np.where(near, x[np.where(near, to - c * rows, 0)], 0.0)
        out = [(k, int(i), None, float(v), None) for i, v in zip(b, (met * y[:, None]).sum(0))]
        i, j = np.nonzero(~near)
        far = to[i, j] // rows
        for t in np.unique(far):
            at = far == t
            cells = np.zeros(int(at.sum()), cell)
            cells["b"], cells["at"], cells["y"] = j[at], to[i[at], j[at]] - t * rows, y[i[at]]
            out.append((k, None, int(t), None, cells.tobytes()))
        out = pd.DataFrame(out, columns=["_k", "b", "_c", "s", "cells"]).astype({"b": "Int64", "_c": "Int64"})
        for name in reversed(keys):
            out.insert(0, name, pdf[name].iloc[0])
        return out

    def receive(cells, pdf):
        x = pdf.sort_values("px")["x"].to_numpy()
        got = np.concatenate([np.frombuffer(b, cell) for b in cells["cells"]])
        first = int(cells["_k"].iloc[0]) * block
        s = np.bincount(got["b"], weights=x[got["at"]] * got["y"])
        out = pd.DataFrame({"b": first + np.arange(len(s)), "s": s})
        for name in reversed(keys):
            out.insert(0, name, cells[name].iloc[0])
        return out

    draws = d.count() * replicates
    placed = dealt(d.withColumn("_c", F.expr(f"px div {rows}")), ["px"], draws)
    blocks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // block))).alias("_k")
    group = [*keys, "_c", "_k"]
    sent = cut(dealt(placed.select("*", blocks), group, draws).groupBy(*group).applyInPandas(pair, _schema(d, keys, "_k int, b long, _c long, s double, cells binary")))
    sums = sent.where("s is not null").select(*keys, "b", "s")
    far = sent.where("cells is not null")
    # Only the chunks and blocks that cells were sent to are read again.
    wanted = placed.select(*keys, "_c", "px", "x").join(far.select(*group).distinct(), [*keys, "_c"])
    wanted = wanted.select(*[F.col(c).alias(c) for c in wanted.columns])
    got = far.groupBy(*group).cogroup(wanted.groupBy(*group)).applyInPandas(receive, _schema(d, keys, "b long, s double"))
    stat = sums.unionByName(got).groupBy(*keys, "b").agg(F.sum("s").alias("_s"))
    stat = attach(stat, scale, keys, "inner").select(*keys, F.col("b").cast("int").alias("b"), F.try_divide("_s", root).alias("stat"))
    return scale.where("n >= 3").select(*keys, F.try_divide("_xy", root).alias("rho"), "n"), stat


def permutation_p(df: DataFrame, keys: Sequence[str], replicates: int, seed: int = 42) -> DataFrame:
    """P-08: share of random re-pairings at least as strongly rank-correlated (add-one)."""
    keys = list(keys)
    obs, stat = permutation_correlations(df, keys, replicates, seed)
    r = attach(stat, obs.drop("n"), keys, "inner")
    return r.groupBy(*keys).agg(
        F.max("rho").alias("rho"),
        ((F.sum((F.abs("stat") >= F.abs("rho") - 1e-12).cast("long")) + 1) / F.lit(replicates + 1)).alias("p_perm"),
    )


def bca_ci(df: DataFrame, keys: Sequence[str], replicates: int, level: float = 0.95, seed: int = 42) -> DataFrame:
    """P-07: bias-corrected and accelerated interval of the Pearson correlation."""
    keys = list(keys)
    reps = cut(bootstrap_correlations(df, keys, replicates, "pearson", seed))
    obs = pearson_by(df, keys, "x", "y", 3, "theta").drop("n")
    jk = with_group_aggs(jackknife(df, keys), keys, _m=F.avg("stat"))
    dev = F.col("_m") - F.col("stat")
    acc = jk.groupBy(*keys).agg((F.sum(dev**3) / (6.0 * F.pow(F.sum(dev**2), F.lit(1.5)))).alias("acc"))
    b = attach(reps, obs, keys, "inner").groupBy(*keys).agg(
        F.max("theta").alias("theta"), F.avg((F.col("stat") < F.col("theta")).cast("double")).alias("below"), F.count("stat").alias("nb")
    )
    b = join_keys(b, acc, keys).withColumn("z0", normal_quantile(F.greatest(F.least("below", 1 - 0.5 / F.col("nb")), 0.5 / F.col("nb"))))
    a = (1 - level) / 2
    b = b.withColumn("_zl", normal_quantile(F.lit(a))).withColumn("_zh", normal_quantile(F.lit(1 - a)))
    adj = lambda z: F.col("z0") + (F.col("z0") + F.col(z)) / (1 - F.col("acc") * (F.col("z0") + F.col(z)))
    b = b.withColumn("_pl", normal_cdf(adj("_zl"))).withColumn("_ph", normal_cdf(adj("_zh")))
    # Ranked replicates: take the values at the two adjusted positions.
    c = attach(cumulative_counts(reps, keys, "stat"), b, keys, "inner")
    at = lambda p: F.min(F.when(F.col("n_below") + F.col("n_equal") >= F.col(p) * (F.col("nb") - 1) + 1e-9, F.col("stat")))
    return c.groupBy(*keys).agg(F.max("theta").alias("theta"), at("_pl").alias("ci_low"), at("_ph").alias("ci_high"))


def correlation_table(pairs: DataFrame, family: Sequence[str] = ("y",), replicates: int = 0, seed: int = 42) -> DataFrame:
    """P-12: Spearman table with p, FDR per family, stars, artefact flag, optional CI.

    ``pairs`` rows: x, y (names), unit, vx, vy.
    """
    from colloquy.functions.scalars import artefact_suspect, stars

    r = spearman_by(pairs, ["x", "y"], "vx", "vy")
    r = cut(r.withColumn("p", correlation_p(F.col("rho"), F.col("n"))))
    t = bh_fdr(r, family)
    t = t.withColumn("stars", stars(F.col("p_fdr"))).withColumn("artefact_suspect", F.coalesce(artefact_suspect(F.col("rho"), F.col("n")), F.lit(False)))
    if replicates:
        d = pairs.select(F.col("x").alias("fx"), F.col("y").alias("fy"), "unit", F.col("vx").alias("x"), F.col("vy").alias("y"))
        ci = percentile_ci(cut(bootstrap_correlations(d, ["fx", "fy"], replicates, "spearman", seed)), ["fx", "fy"])
        t = t.join(ci.withColumnRenamed("fx", "x").withColumnRenamed("fy", "y"), ["x", "y"], "left")
    return t


def correlation_metrics(df: DataFrame, keys: Sequence[str], replicates: int, seed: int = 42) -> DataFrame:
    """P-09: rho, n, p, bootstrap interval, permutation p and leave-one-out range."""
    keys = list(keys)
    r = spearman_by(df, keys, "x", "y")
    r = r.withColumn("p", correlation_p(F.col("rho"), F.col("n")))
    ci = percentile_ci(cut(bootstrap_correlations(df, keys, replicates, "spearman", seed)), keys)
    perm = permutation_p(df, keys, replicates, seed).drop("rho")
    return join_keys(join_keys(join_keys(r, ci, keys, "left"), perm, keys, "left"), leave_one_out_range(df, keys), keys, "left")
