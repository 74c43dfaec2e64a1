"""SQL twins of the seeded draws: counts of bootstrap replicates, permutations, and normal probabilities."""

from colloquy.stats.draws import MULTIPLIERS, POISSON, ROUNDS, SHIFTS, STRIDE

SEED = 42
WORD = 1 << 32


def mixed(x: str, name: str) -> str:
    """Select list that ends with ``name``: the mixed value of the column or expression ``x``."""
    steps, last = [], x
    for i, shift in enumerate(SHIFTS):
        steps.append(f"xor(({last})::UBIGINT, ({last})::UBIGINT >> {shift}) AS {name}_x{i}")
        last = f"{name}_x{i}"
        if i < len(MULTIPLIERS):
            steps.append(f"({last} * {MULTIPLIERS[i]}::UBIGINT) % {WORD} AS {name}_m{i}")
            last = f"{name}_m{i}"
    return ", ".join([*steps, f"{last} AS {name}"])


def replicates(n: int) -> str:
    """CTE reps: b and its key."""
    return f"reps AS (SELECT b, key FROM (SELECT b, {mixed(f'(b * {STRIDE} + {SEED}) % {WORD}', 'key')} FROM (SELECT unnest(range({n})) b)))"


def counted(source: str, unit: str = "unit") -> str:
    """CTE dr: the rows of ``source`` in every replicate with their count w; units are whole numbers below 2^32."""
    hits = " + ".join(f"(draw >= {t})::INT" for t in POISSON)
    cols = f"{mixed(f'({unit} + key) % {WORD}', 'lo')}, {mixed('key', 'h0')}, {mixed('h0', 'hi')}, {mixed('xor(lo, hi)', 'draw')}"
    return f"dr AS (SELECT * EXCLUDE (w), ({hits})::BIGINT w FROM (SELECT *, 0 w, {cols} FROM {source}, reps))"


# Rank correlation of every replicate of dr (k, unit, x, y, b, w), and its percentile interval.
SPEARMAN = """rw AS (SELECT k, b, w, 2 * sum(w) OVER (PARTITION BY k, b ORDER BY x) - sum(w) OVER (PARTITION BY k, b, x) - sum(w) OVER (PARTITION BY k, b) vx,
 2 * sum(w) OVER (PARTITION BY k, b ORDER BY y) - sum(w) OVER (PARTITION BY k, b, y) - sum(w) OVER (PARTITION BY k, b) vy FROM dr),
st AS (SELECT k, b, sum(w * vx * vy) / nullif(sqrt(sum(w * vx * vx)) * sqrt(sum(w * vy * vy)), 0) stat FROM rw GROUP BY ALL)"""
INTERVAL = "ci AS (SELECT k, quantile_cont(stat, 0.025) ci_low, quantile_cont(stat, 0.975) ci_high FROM st GROUP BY ALL)"


def mixed_in_lambda(x: str) -> str:
    """The mixed value as one expression that names ``x`` once."""
    shifts, multipliers = list(SHIFTS), [*MULTIPLIERS, 1]
    return f"list_reduce(range({len(shifts)}), lambda c, j: (xor(c, c >> ({shifts}::UBIGINT[])[j::INT + 1]) * ({multipliers}::UBIGINT[])[j::INT + 1]) % {WORD}::UBIGINT, ({x})::UBIGINT)"


def permuted() -> str:
    """CTEs pl (rows of d with their place by x and centred twice-ranks), fe and pm (k, i, b, v): where each place goes."""
    turn = f"xor(v // low, {mixed_in_lambda('xor(v % low, ks[r::INT + 1])')} % low) + (v % low) * low"
    step = f"list_reduce(range({ROUNDS}), lambda v, r: {turn}, v::UBIGINT)::BIGINT"
    keys = ", ".join(f"k{r}" for r in range(ROUNDS))
    cols = ", ".join(mixed(f"(key + {r}) % {WORD}", f"k{r}") for r in range(ROUNDS))
    return f"""pl AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x, unit) - 1 i, count(*) OVER (PARTITION BY k) n,
 2 * rank() OVER (PARTITION BY k ORDER BY x) + count(*) OVER (PARTITION BY k, x) - 2 - count(*) OVER (PARTITION BY k) vx,
 2 * rank() OVER (PARTITION BY k ORDER BY y) + count(*) OVER (PARTITION BY k, y) - 2 - count(*) OVER (PARTITION BY k) vy FROM d),
rk AS (SELECT b, [{keys}] ks FROM (SELECT b, {cols} FROM reps)),
fe AS (SELECT k, i, n, b, ks, (1 << greatest(4, (length(bin(greatest(n, 2) - 1)) + 1) // 2))::UBIGINT low, i::BIGINT v, 0 s FROM pl, rk
 UNION ALL SELECT k, i, n, b, ks, low, {step}, 1 FROM fe WHERE s = 0 OR v >= n),
pm AS (SELECT k, i, b, v FROM fe WHERE s = 1 AND v < n),
ob AS (SELECT k, sum(vx * vy) / sqrt(sum(vx * vx)) / sqrt(sum(vy * vy)) rho, sqrt(sum(vx * vx)) * sqrt(sum(vy * vy)) root, count(*) n FROM pl GROUP BY ALL),
ps AS (SELECT k, b, sum(p.vy * q.vx) / any_value(root) stat FROM pm JOIN pl p USING (k, i) JOIN pl q ON q.k = pm.k AND q.i = pm.v JOIN ob USING (k) GROUP BY ALL),
pp AS (SELECT k, any_value(rho) rho, (count(*) FILTER (abs(stat) >= abs(rho) - 1e-12) + 1) / (count(*) + 1.0) p_perm FROM ps JOIN ob USING (k) GROUP BY ALL)"""


# Rank correlation without each unit of d.
LEAVE_ONE_OUT = """lj AS (SELECT u.k, u.unit, d.x, d.y FROM d u JOIN d ON u.k = d.k AND u.unit <> d.unit),
lr AS (SELECT k, unit, rank() OVER (PARTITION BY k, unit ORDER BY x) + (count(*) OVER (PARTITION BY k, unit, x) - 1) / 2.0 rx, rank() OVER (PARTITION BY k, unit ORDER BY y) + (count(*) OVER (PARTITION BY k, unit, y) - 1) / 2.0 ry FROM lj),
lo AS (SELECT k, unit, corr(rx::DOUBLE, ry::DOUBLE) stat FROM lr GROUP BY ALL)"""


def phi(z: str) -> str:
    """Normal distribution function by its series around 0."""
    term = f"exp((2 * j + 1) * ln(abs({z}) + 1e-300) - (j + 1) * ln(2) - lgamma(j + 1.5) + 0.5 * ln(pi()))"
    return f"(0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda j: {term})))"
