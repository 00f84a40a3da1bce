"""Series expressions as steps of SQL, laid in as few projections as their dependencies allow.

An operator names intermediate columns with let(); equal expressions are one column, whichever operators ask for
them. For Spark the steps become projections of a DataFrame that Catalyst plans as one chain of windows over one
exchange by instrument. The same steps can be written out as one SQL statement for another engine, which is how
results are compared; the few functions that differ between dialects are methods here.

A null is a missing value throughout. Windows are by instrument in the order of pos.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = "PARTITION BY instrument ORDER BY pos"


class Steps:
    def __init__(self, dialect: str = "spark"):
        self.spark = dialect == "spark"
        self.names: dict[str, str] = {}
        self.levels: list[list[tuple[str, str]]] = []
        self.level_of: dict[str, int] = {}
        self.notes: dict[str, dict] = {}

    def noted(self, expression: str, **facts) -> str:
        """An output with facts that its column is to carry."""
        self.notes[expression] = facts
        return expression

    def let(self, expression: str) -> str:
        """The name of a column with that value."""
        if expression not in self.names:
            name = f"_{len(self.names)}"
            level = max((self.level_of[x] + 1 for x in re.findall(r"(?<![\w.])_\d+(?!\w)", expression)), default=0)
            while len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append((name, expression))
            self.names[expression], self.level_of[name] = name, level
        return self.names[expression]

    def over(self, df: DataFrame, outputs: dict[str, str], keep: list[str] | None = None) -> DataFrame:
        """The columns to keep (all, if not given) and the outputs, name to expression over steps.

        Facts noted about an output become metadata of its column, with what names the rows that it is made of."""
        kept = keep or df.columns
        made_of = str(df.semanticHash()) if self.notes else ""
        told = {n: {"metadata": self.notes[e] | {"made_of": made_of}} if e in self.notes else {} for n, e in outputs.items()}
        for level in self.levels:
            df = df.select("*", *(F.expr(e).alias(n) for n, e in level))
        return df.select(*kept, *(F.expr(e).alias(n, **told[n]) for n, e in outputs.items()))

    def sql(self, source: str, outputs: dict[str, str], keep: list[str]) -> str:
        """The same as one statement over a table or a parenthesised query."""
        for level in self.levels:
            source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in level)} FROM {source})"
        return f"SELECT {', '.join([*keep, *(f'{e} AS {n}' for n, e in outputs.items())])} FROM {source}"

    # windows

    @staticmethod
    def last(n: int) -> str:
        return f"({KEYS} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    @staticmethod
    def frame(start: str, stop: str) -> str:
        return f"({KEYS} ROWS BETWEEN {start} AND {stop})"

    ALL = f"({KEYS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    BEFORE = f"({KEYS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    def lag(self, x: str, n: int = 1) -> str:
        return self.let(f"lag({x}, {n}) OVER ({KEYS})")

    def lead(self, x: str, n: int = 1) -> str:
        return self.let(f"lead({x}, {n}) OVER ({KEYS})")

    def roll(self, f: str, x: str, n: int, least: int | None = None) -> str:
        """An aggregate of the last n bars, where at least `least` (n) of them have a value."""
        x = self.let(x)
        return self.let(f"CASE WHEN count({x}) OVER {self.last(n)} >= {n if least is None else least} THEN {f}({x}) OVER {self.last(n)} END")

    def total(self, x: str) -> str:
        return self.let(f"sum({self.let(x)}) OVER {self.ALL}")

    # what dialects write differently

    def listed(self, x: str, frame: str) -> str:
        return self.let(f"{'collect_list' if self.spark else 'list'}({x}) {'' if self.spark else f'FILTER (WHERE {x} IS NOT NULL) '}OVER {frame}")

    def fold(self, array: str, start: str, acc: str, x: str, body: str) -> str:
        if self.spark:
            return f"aggregate({array}, {start}, ({acc}, {x}) -> {body})"
        return f"coalesce(list_reduce({array}, lambda {acc}, {x}: {body}, {start}), {start})"

    def mapped(self, array: str, x: str, body: str) -> str:
        return f"transform({array}, {x} -> {body})" if self.spark else f"list_transform({array}, lambda {x}: {body})"

    def kept(self, array: str, x: str, body: str) -> str:
        return f"filter({array}, {x} -> {body})" if self.spark else f"list_filter({array}, lambda {x}: {body})"

    def size(self, array: str) -> str:
        return f"size({array})" if self.spark else f"coalesce(len({array}), 0)"

    def list_sum(self, array: str) -> str:
        return f"aggregate({array}, cast(0 as double), (s, v) -> s + v)" if self.spark else f"list_sum({array})"

    def skewed(self, x: str, n: int, order: int) -> str:
        """Bias-corrected skewness (order 3) or excess kurtosis (order 4) of the last n bars."""
        frame = self.last(n)
        if not self.spark:
            return self.let(f"CASE WHEN count({x}) OVER {frame} >= {n} THEN {'skewness' if order == 3 else 'kurtosis'}({x}) OVER {frame} END")
        if order == 3:
            return self.let(f"CASE WHEN count({x}) OVER {frame} >= {n} THEN skewness({x}) OVER {frame} * {(n * (n - 1)) ** 0.5 / (n - 2)!r}D END")
        return self.let(f"CASE WHEN count({x}) OVER {frame} >= {n} THEN {(n - 1) / ((n - 2) * (n - 3))!r}D * ({n + 1} * (kurtosis({x}) OVER {frame}) + 6) END")

    @staticmethod
    def num(x: float) -> str:
        """A double, in both dialects."""
        return f"cast({x!r} as double)"

    @staticmethod
    def ratio(a: str, b: str) -> str:
        """a / b; nothing where b is 0."""
        return f"({a}) / nullif({b}, 0)"

    def logged(self, x: str) -> str:
        return f"CASE WHEN {x} > 0 THEN ln(CASE WHEN {x} > 0 THEN {x} END) END"

    # recurrences

    def ema(self, x: str, alpha: float, least: int) -> str:
        """y = (1 - alpha) y' + alpha x from the first value on, given from the least-th value on.

        A missing value leaves y as it is but lets the past decay. In Spark a scan in three levels: cumulative products
        and sums within 64 values, a fold over the ends of the at most 63 blocks before in the same span of 4,096 values,
        and one over the ends of the spans before. Elsewhere a plain fold.
        """
        x = self.let(x)
        k = self.let(f"count({x}) OVER {self.ALL}")
        seen = self.let(f"CASE WHEN {x} IS NOT NULL THEN pos END")
        gap = self.let(f"pos - max({seen}) OVER {self.BEFORE}")
        keep = self.let(f"CASE WHEN {x} IS NULL THEN NULL WHEN {k} = 1 THEN {self.num(1.0)} ELSE power({self.num(1 - alpha)}, {gap}) / (power({self.num(1 - alpha)}, {gap}) + {self.num(alpha)}) END")
        add = self.let(f"CASE WHEN {k} = 1 THEN {x} ELSE (1 - {keep}) * {x} END")
        if not self.spark:
            pairs = self.let(f"list({{'a': {keep}, 'b': {add}}}) FILTER (WHERE {x} IS NOT NULL) OVER {self.ALL}")
            value = self.let(f"list_reduce({pairs}, lambda y, v: {{'a': v.a, 'b': y.b * v.a + v.b}}).b")
            return self.let(f"CASE WHEN {k} >= {least} THEN {value} END")
        block = self.let(f"({k} - 1) div 64")
        inner = f"(PARTITION BY instrument, {block} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        product = self.let(f"exp(sum(ln({keep})) OVER {inner})")
        scaled = self.let(f"{add} / {product}")
        part = self.let(f"{product} * sum({scaled}) OVER {inner}")
        span = self.let(f"({k} - 1) div 4096")
        of_span = f"(PARTITION BY instrument, {span} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        ends = self.let(f"collect_list(CASE WHEN {x} IS NOT NULL AND {k} % 64 = 0 THEN struct({block} AS b, {product} AS p, {part} AS s) END) OVER {of_span}")
        none = f"struct({self.num(1.0)} AS p, {self.num(0.0)} AS s)"
        within = self.let(f"aggregate(filter({ends}, t -> t.b < {block}), {none}, (y, t) -> struct(y.p * t.p AS p, y.s * t.p + t.s AS s))")
        spans = self.let(f"collect_list(CASE WHEN {x} IS NOT NULL AND {k} % 4096 = 0 THEN struct({span} AS b, {product} * {within}.p AS p, {product} * {within}.s + {part} AS s) END) OVER {self.BEFORE}")
        carry = self.let(f"aggregate(filter({spans}, t -> t.b < {span}), {self.num(0.0)}, (y, t) -> y * t.p + t.s)")
        return self.let(f"CASE WHEN {k} >= {least} THEN {product} * ({within}.p * {carry} + {within}.s) + {part} END")
