import pytest


def rows(df, *columns):
    """Rows as sorted tuples, so order and partitioning do not matter."""
    data = (df.select(*columns) if columns else df).collect()
    return sorted((tuple(r) for r in data), key=repr)


def one(df):
    """The single value of a one-row, one-column table."""
    (row,) = df.collect()
    return row[0]


def value(spark, column):
    return one(spark.range(1).select(column.alias("v")))


def fails(df, text):
    with pytest.raises(Exception) as caught:
        df.collect()
    assert text in str(caught.value)
