"""SQL twins of small matrix work: principal components by repeated squaring and deflation, least squares by determinants."""


def components(source: str, cols, k: int, tag: str = "") -> str:
    """CTEs (recursive) up to pc{tag} (component, feature, weight, loading, eigenvalue, variance_share) of complete rows of ``source``."""
    p = len(cols)
    dot = lambda a, b: f"list_sum(list_transform(range({p}), lambda z: {a}[z + 1] * {b}[z + 1]))"
    each = lambda f: f"list_transform(range({p}), lambda i: {f})"
    full = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    r0 = "[" + ", ".join("[" + ", ".join("1.0::DOUBLE" if a == b else f"corr({a}, {b})" for b in cols) + "]" for a in cols) + "]"
    parts = [f"r{tag}0 AS (SELECT {r0} m FROM {source} WHERE {full})"]
    for j in range(1, k + 1):
        last, power, column, vector, pair = (f"{x}{tag}{j}" for x in ("r", "w", "c", "v", "e"))
        before = f"r{tag}{j - 1}"
        square = each(f"list_transform(range({p}), lambda h: list_sum(list_transform(range({p}), lambda z: m[i + 1][z + 1] * m[z + 1][h + 1])) / size)")
        size = f"list_sum(list_transform(m, lambda r: list_sum(list_transform(r, lambda x: x * x)))) size"
        diagonal = each("m[i + 1][i + 1]")
        parts += [
            f"{power} AS (SELECT m, 0 s FROM {before} UNION ALL SELECT {square}, s + 1 FROM (SELECT m, s, {size} FROM {power} WHERE s < 20))",
            f"{column} AS (SELECT list_transform(m, lambda r: r[best]) u FROM (SELECT m, list_position({diagonal}, list_max({diagonal})) best FROM {power} WHERE s = 20))",
            f"{vector} AS (SELECT list_transform(u, lambda x: x / len * sgn) v FROM (SELECT u, sqrt({dot('u', 'u')}) len, sign(u[list_position(list_transform(u, lambda x: abs(x)), list_max(list_transform(u, lambda x: abs(x))))]) sgn FROM {column}))",
            f"{pair} AS (SELECT v, {dot('v', 'mv')} l FROM (SELECT v, {each(dot('m[i + 1]', 'v'))} mv FROM {vector}, r{tag}0))",
            f"{last} AS (SELECT {each(f'list_transform(range({p}), lambda h: m[i + 1][h + 1] - l * v[i + 1] * v[h + 1])')} m FROM {before}, {pair})",
        ]
    names = "[" + ", ".join(f"'{c}'" for c in cols) + "]"
    rows = " UNION ALL ".join(f"SELECT {j} component, unnest({names}) feature, unnest(v) weight, unnest(list_transform(v, lambda x: x * sqrt(l))) loading, l eigenvalue, l / {p} variance_share FROM e{tag}{j}" for j in range(1, k + 1))
    return ", ".join([*parts, f"pc{tag} AS ({rows})"])


def scores(source: str, cols, k: int, unit: str, tag: str = "") -> str:
    """CTE ps{tag} (unit, PC1, ...): rows of ``source`` on the components, z-scored by complete rows."""
    full = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    z = ", ".join(f"({c} - m{i}) / s{i} z{i}" for i, c in enumerate(cols))
    m = ", ".join(f"avg({c}) m{i}, stddev_pop({c}) s{i}" for i, c in enumerate(cols))
    out = ", ".join(" + ".join(f"z{i} * e{tag}{j}.v[{i + 1}]" for i in range(len(cols))) + f" PC{j}" for j in range(1, k + 1))
    return f"ps{tag} AS (SELECT {unit}, {out} FROM (SELECT {unit}, {z} FROM {source}, (SELECT {m} FROM {source} WHERE {full})), {', '.join(f'e{tag}{j}' for j in range(1, k + 1))})"


def determinant(m) -> str:
    if len(m) == 1:
        return m[0][0]
    minor = lambda j: [[c for i, c in enumerate(r) if i != j] for r in m[1:]]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {m[0][j]} * {determinant(minor(j))}" for j in range(len(m))) + ")"


def fitted(source: str, y: str, xs) -> str:
    """SELECT n, slopes b0.. with inverse terms v0.., r2, rss of one model on rows of ``source`` that are complete."""
    k, cols = len(xs), [*xs, y]
    full = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    sums = ", ".join(f"sum(({cols[i]} - m{i}) * ({cols[j]} - m{j})) s{i}_{j}" for i in range(k + 1) for j in range(i, k + 1))
    means = ", ".join(f"avg({c}) m{i}" for i, c in enumerate(cols))
    a = [[f"s{min(i, j)}_{max(i, j)}" for j in range(k)] for i in range(k)]
    det = determinant(a)
    beta = [determinant([[f"s{i}_{k}" if j == t else a[i][j] for j in range(k)] for i in range(k)]) + f" / {det}" for t in range(k)]
    inverse = [(determinant([[c for j, c in enumerate(r) if j != t] for i, r in enumerate(a) if i != t]) if k > 1 else "1.0") + f" / {det}" for t in range(k)]
    betas = ", ".join(f"{b} b{t}, {v} v{t}" for t, (b, v) in enumerate(zip(beta, inverse)))
    r2 = "(" + " + ".join(f"b{t} * s{t}_{k}" for t in range(k)) + f") / s{k}_{k}"
    return f"SELECT *, (1 - r2) * s{k}_{k} rss FROM (SELECT *, {r2} r2 FROM (SELECT *, {betas} FROM (SELECT count(*) n, {sums} FROM {source}, (SELECT {means} FROM {source} WHERE {full}) WHERE {full})))"


def least_squares(source: str, y: str, xs, model: str) -> str:
    """SELECT model, term, n, beta, se, r2 of the slopes."""
    k = len(xs)
    return " UNION ALL ".join(f"SELECT '{model}' model, '{x}' term, n, b{t} beta, sqrt(rss / (n - {k + 1}) * v{t}) se, r2 FROM ({fitted(source, y, xs)})" for t, x in enumerate(xs))


def type_two(source: str, y: str, tests: dict, whole) -> str:
    """SELECT term, ss, df, ss_resid, df_resid, f, partial_eta2 of one-column terms: {term: (columns without it, its column)}."""
    parts = []
    for term, (others, own) in tests.items():
        without = f"(SELECT rss FROM ({fitted(source, y, others)}))"
        parts.append(f"SELECT '{term}' term, {without} - (SELECT rss FROM ({fitted(source, y, [*others, own])})) ss, rss, n - {len(whole) + 1} dfe FROM ({fitted(source, y, whole)})")
    return f"SELECT term, ss, 1.0::DOUBLE df, rss ss_resid, dfe::DOUBLE df_resid, ss / (rss / dfe) f, ss / (ss + rss) partial_eta2 FROM ({' UNION ALL '.join(parts)})"
