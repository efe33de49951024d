"""Ordered scans that stay balanced when one key holds most rows.

Latches, rolling means and last-value fills read rows in order inside a key.
A window over the whole key puts a hot key into one task. A ``Timeline`` cuts
every key's rows into chunks along the order column instead. Rows are windowed
per (key, chunk); what a chunk has to know about the rows before it is a small
summary per chunk, folded along the key and joined back. Results do not depend
on the chunk width.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "_chunk"
# Chunk widths by kind of order column: a day of seconds, or so many numbers. At a
# row per second and key a chunk is small enough for one task to sort in memory.
WIDTHS = {"time": 86_400.0, "number": 65_536.0}


def position(df: DataFrame, name: str) -> Column:
    """The order column as a whole number: microseconds for times, itself for integers."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        # Built from date parts, so it ignores the session time zone.
        parts = F.hour(col) * 3600 + F.minute(col) * 60
        day = F.unix_date(F.to_date(col)).cast("bigint") * 86_400 + parts
        return day * 1_000_000 + (F.extract(F.lit("SECOND"), col) * 1_000_000).cast("bigint")
    return col.cast("bigint")


@dataclass(frozen=True)
class Timeline:
    """Row order inside ``keys``; ``width`` cuts it into chunks, None means one chunk.

    ``width`` is in seconds for times, down to a microsecond, and in units for
    numbers. NULL keys are a key, and NULLs in the order come first, with any
    width.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    width: float | None = None

    @classmethod
    def chunked(cls, df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> Timeline:
        """Chunks of the usual width for the kind of ``order``; looks at the schema only."""
        numeric = isinstance(df.schema[order[0]].dataType, T.IntegralType)
        return cls(tuple(keys), tuple(order), WIDTHS["number" if numeric else "time"])

    @property
    def group(self) -> list[str]:
        return [*self.keys, CHUNK] if self.width else list(self.keys)

    @property
    def rows(self) -> WindowSpec:
        """Rows of one chunk, in order."""
        return Window.partitionBy(*self.group).orderBy(*self.order)

    @property
    def at(self) -> Column:
        """Order of a row as one comparable value, which is never NULL itself."""
        return F.struct(*self.order)

    def cut(self, df: DataFrame) -> DataFrame:
        """Add the chunk number, once."""
        if not self.width or CHUNK in df.columns:
            return df
        is_number = isinstance(df.schema[self.order[0]].dataType, T.IntegralType)
        unit = max(1, round(self.width if is_number else self.width * 1_000_000))
        at = position(df, self.order[0])
        return df.withColumn(CHUNK, (at - F.pmod(at, F.lit(unit))) / F.lit(unit))

    def carry(
        self,
        df: DataFrame,
        summary: DataFrame,
        folds: dict[str, Callable[[WindowSpec], Column]],
        kinds: dict[str, str],
    ) -> DataFrame:
        """Join to each row what the chunks before its own add up to.

        ``summary`` holds one row per (key, chunk). ``folds`` builds each
        carried column from a window over the key's chunks; the window grows
        with the number of chunks, not of rows. With one chunk per key there
        is nothing before it and the columns are NULL of the type in ``kinds``.
        """
        if not self.width:
            return df.withColumns({n: F.lit(None).cast(kinds[n]) for n in folds})
        chunks = Window.partitionBy(*self.keys).orderBy(CHUNK)
        own = [F.col(c).alias(f"_of_{c}") for c in self.group]
        carried = summary.select(*own, *[f(chunks).alias(n) for n, f in folds.items()])
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in self.group])
        return df.join(carried, same, "left").drop(*[f"_of_{c}" for c in self.group])

    def summarize(self, df: DataFrame, **aggs: Column) -> DataFrame:
        """One row per chunk from aggregates that combine before the shuffle."""
        return self.cut(df).groupBy(*self.group).agg(*[c.alias(n) for n, c in aggs.items()])

    def tails(self, df: DataFrame, value: str, n: int, name: str) -> DataFrame:
        """The last ``n`` values of each chunk, oldest first.

        Ranked top-n, which Spark limits per task before the shuffle.
        """
        newest = Window.partitionBy(*self.group).orderBy(*[F.desc(c) for c in self.order])
        last = self.cut(df).select(*self.group, *self.order, value)
        last = last.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n)
        ordered = F.array_sort(F.collect_list(F.struct(*self.order, value)))
        return last.groupBy(*self.group).agg(F.transform(ordered, lambda s: s[value]).alias(name))

    def drop(self, df: DataFrame) -> DataFrame:
        return df.drop(CHUNK)

    # The three folds the operators share.

    def last_known(self, df: DataFrame, **cols: str) -> DataFrame:
        """Fill each column in ``cols`` (new name -> source) with its latest non-NULL value."""
        df = self.cut(df)
        seen = self.rows.rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumns({n: F.last(c, ignorenulls=True).over(seen) for n, c in cols.items()})
        if not self.width:
            return out
        newest = {n: F.max_by(c, F.when(F.col(c).isNotNull(), self.at)) for n, c in cols.items()}
        before = {f"_before_{n}": _last_before(n) for n in cols}
        out = self.carry(out, self.summarize(df, **newest), before, {})
        out = out.withColumns({n: F.coalesce(n, f"_before_{n}") for n in cols})
        return out.drop(*before)

    def number(self, df: DataFrame, name: str) -> DataFrame:
        """Number the rows of a key 1, 2, 3 … in order."""
        return self.running_count(df, name, F.lit(True))

    def running_count(self, df: DataFrame, name: str, flag: Column) -> DataFrame:
        """Count of rows so far, this one included, where ``flag`` holds."""
        df = self.cut(df).withColumn("_one", flag.cast("bigint"))
        seen = self.rows.rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumn(name, F.coalesce(F.sum("_one").over(seen), F.lit(0)))
        if self.width:
            heads = self.summarize(df, _n=F.sum("_one"))
            out = self.carry(out, heads, {"_before": _sum_before("_n")}, {})
            out = out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")
        return out.drop("_one")


def _last_before(col: str) -> Callable[[WindowSpec], Column]:
    return lambda w: F.last(col, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1)
    )


def _sum_before(col: str) -> Callable[[WindowSpec], Column]:
    return lambda w: F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, -1))
