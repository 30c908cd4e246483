"""User functions: chains of Column or row functions before and after an operator, and whole operators by partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

OPERATORS: dict[str, Callable[..., DataFrame]] = {}


def operator(name: str) -> Callable:
    """Registers a function from DataFrames to a DataFrame as a named operator."""

    def add(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        OPERATORS[name] = run
        return run

    return add


def composed(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Steps as one; as in function composition, the last listed runs first."""

    def run(df: DataFrame) -> DataFrame:
        for step in reversed(steps):
            df = step(df)
        return df

    return run


def by_row(function: Callable[[dict], dict | None], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A step from a row function over dictionaries; None drops the row. Use Column functions where they suffice."""

    def batches(parts: Iterator) -> Iterator:
        import pandas as pd

        for part in parts:
            rows = [r for r in map(function, part.to_dict("records")) if r is not None]
            if rows:
                yield pd.DataFrame(rows)

    return lambda df: df.mapInPandas(batches, schema)


def invoke(df: DataFrame, make: Callable[[], object], schema: str, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """A scripted operator: on_start(), on_data(row) and on_done() each return any rows. A new object for each partition, or
    with `by` for each key, whose rows it sees in the order of the columns `order` and never holds all at once."""

    def by_key(parts: Iterator) -> Iterator:
        import pandas as pd

        key, held = None, None
        for part in parts:
            rows = []
            for row in part.to_dict("records"):
                now = tuple(None if row[c] != row[c] else row[c] for c in by)  # nulls of numbers come as NaN
                if held is None or now != key:
                    rows.extend((getattr(held, "on_done", list)() or []) if held is not None else [])
                    key, held = now, make()
                    rows.extend(getattr(held, "on_start", list)() or [])
                rows.extend(held.on_data(row) or [])
            if rows:
                yield pd.DataFrame(rows)
        if held is not None and (rows := getattr(held, "on_done", list)() or []):
            yield pd.DataFrame(rows)

    if by:
        return df.repartition(*by).sortWithinPartitions(*by, *(order or [])).mapInPandas(by_key, schema)

    def batches(parts: Iterator) -> Iterator:
        import pandas as pd

        held = make()
        rows = list(getattr(held, "on_start", list)() or [])
        for part in parts:
            for row in part.to_dict("records"):
                rows.extend(held.on_data(row) or [])
            if rows:
                yield pd.DataFrame(rows)
                rows = []
        rows.extend(getattr(held, "on_done", list)() or [])
        if rows:
            yield pd.DataFrame(rows)

    return df.mapInPandas(batches, schema)
