"""A relation that is a DataFrame, or the SQL text of the same for another engine.

Operators are written once on relations: steps() adds series columns, agg() groups, join(), where() and select()
do what they say. On a DataFrame each is the DataFrame operation; on text it wraps a statement.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.steps import Steps


class Rel:
    def __init__(self, source: DataFrame | str):
        self.source, self.spark = source, not isinstance(source, str)

    @property
    def df(self) -> DataFrame:
        return self.source

    @property
    def sql(self) -> str:
        return f"SELECT * FROM {self.source}"

    def one(self, spark: str, other: str) -> str:
        """The expression of this dialect."""
        return spark if self.spark else other

    def steps(self, build: Callable[[Steps], dict[str, str]], keep: list[str] | None = None) -> Rel:
        """The columns to keep (all, if not given) and those that build returns."""
        s = Steps("spark" if self.spark else "sql")
        out = build(s)
        if self.spark:
            return Rel(s.over(self.df, out, keep))
        temps = [n for level in s.levels for n, _ in level]
        return Rel(f"({s.sql(self.source, out, keep or [f'* EXCLUDE ({", ".join(temps)})' if temps else '*'])})")

    def where(self, condition: str) -> Rel:
        return Rel(self.df.where(condition)) if self.spark else Rel(f"(SELECT * FROM {self.source} WHERE {condition})")

    def select(self, *names: str, **made: str) -> Rel:
        if self.spark:
            return Rel(self.df.select(*names, *(F.expr(e).alias(n) for n, e in made.items())))
        return Rel(f"(SELECT {', '.join([*names, *(f'{e} AS {n}' for n, e in made.items())])} FROM {self.source})")

    def agg(self, keys: list[str], **made: str) -> Rel:
        if self.spark:
            return Rel(self.df.groupBy(*keys).agg(*(F.expr(e).alias(n) for n, e in made.items())))
        group = f" GROUP BY {', '.join(keys)}" if keys else ""
        return Rel(f"(SELECT {', '.join([*keys, *(f'{e} AS {n}' for n, e in made.items())])} FROM {self.source}{group})")

    def join(self, other: Rel, on: list[str], how: str = "inner") -> Rel:
        if self.spark:
            return Rel(self.df.join(other.df, on, how))
        word = {"inner": "JOIN", "left": "LEFT JOIN", "left_anti": "ANTI JOIN", "full": "FULL JOIN"}[how]
        return Rel(f"(SELECT * FROM {self.source} AS l {word} {other.source} AS r USING ({', '.join(on)}))")

    def between(self, ranges: Rel, condition: str) -> Rel:
        """Each row with the rows of a small table whose range it lies in; Spark broadcasts that table."""
        if self.spark:
            return Rel(self.df.join(F.broadcast(ranges.df), F.expr(condition)))
        return Rel(f"(SELECT * FROM {self.source} AS l JOIN {ranges.source} AS r ON {condition})")

    def union(self, other: Rel) -> Rel:
        if self.spark:
            return Rel(self.df.unionByName(other.df))
        return Rel(f"(SELECT * FROM {self.source} UNION ALL BY NAME SELECT * FROM {other.source})")

    def melted(self, keys: list[str], rows: list[dict[str, str]]) -> Rel:
        """For each row the keys with one row for each of `rows`, name to expression."""
        if self.spark:
            each = ", ".join(f"struct({', '.join(f'{e} AS {n}' for n, e in r.items())})" for r in rows)
            return Rel(self.df.select(*keys, F.expr(f"inline(array({each}))")))
        each = ", ".join("{" + ", ".join(f"'{n}': {e}" for n, e in r.items()) + "}" for r in rows)
        return Rel(f"(SELECT {', '.join(keys)}, unnest([{each}], recursive := true) FROM {self.source})")

    def rounded(self, *names: str, digits: int = 6, keep: list[str]) -> Rel:
        return self.select(*keep, **{n: f"round(cast({n} as double), {digits}) + 0.0" for n in names})

    def percentile(self, x: str, q: float) -> str:
        """The exact quantile, interpolated."""
        return f"percentile({x}, {q})" if self.spark else f"quantile_cont({x}, {q})"
