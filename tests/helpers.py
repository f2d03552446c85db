"""Comparing rows of Spark and DuckDB."""


def norm(x):
    if isinstance(x, float):
        return None if x != x else repr(round(x, 7))
    if isinstance(x, (list, tuple)):
        return tuple(map(norm, x))
    return None if x is None else str(x)


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(norm(r[k]) for k in names) for r in df.collect()), key=str)


def assert_same(df, con, sql):
    found = con.sql(sql)
    names = list(found.columns)
    assert sorted(names) == sorted(df.columns)
    at = [names.index(k) for k in sorted(names)]
    assert rows_of(df) == sorted((tuple(norm(r[i]) for i in at) for r in found.fetchall()), key=str)
