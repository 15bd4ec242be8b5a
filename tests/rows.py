"""Comparison of query results."""


def same_rows(got, want):
    """Two pandas frames hold the same rows in any order, by column name."""
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    text = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).map(lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x).values.tolist()), key=repr)
    assert text(got) == text(want)
