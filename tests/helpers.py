"""What tests share."""

SF = "/root/testdata/sf0.001"


def plain(rows):
    """Rows in an order, with NaN comparable."""
    return sorted([tuple("nan" if isinstance(v, float) and v != v else v + 0.0 if isinstance(v, float) else v for v in r) for r in rows], key=repr)


def same(df, duck, sql):
    cols = sorted(df.columns)
    a = plain(df.select(*[f"`{c}`" for c in cols]).collect())
    r = duck.sql(sql)
    assert sorted(r.columns) == cols
    assert a == plain(r.project(",".join(f'"{c}"' for c in cols)).fetchall())
