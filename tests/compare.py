"""Comparison of results, shared by the tests."""


def same_rows(spark_df, duck_df):
    """Compare two results whatever the order of their rows and columns."""
    got, want = spark_df.toPandas(), duck_df
    # integers with nulls come as floats
    for name, kind in spark_df.dtypes:
        if kind in ("tinyint", "smallint", "int", "bigint") and got[name].dtype.kind == "f":
            got[name] = got[name].astype("Int64")
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)

    def rows(frame):
        frame = frame[names].astype(object)
        return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))

    assert rows(got) == rows(want)
