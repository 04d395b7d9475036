def rows(df):
    """A table's rows in one order, nulls included."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
