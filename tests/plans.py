"""Look at physical plans."""

from __future__ import annotations


def physical(df) -> str:
    """The plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def final(df) -> str:
    """The plan as adaptive execution ended it."""
    df.collect()
    return physical(df).split("== Initial Plan ==")[0]
