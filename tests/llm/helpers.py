"""Small helpers of the tests."""


def rows_of(df, *names):
    """Rows as tuples of the named columns, in order of the first."""
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=lambda r: tuple((x is not None, x) for x in r))
