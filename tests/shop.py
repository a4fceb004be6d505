"""Helpers of the retail tests."""


def rows_by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
