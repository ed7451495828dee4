"""Look-back along an ordered key that stays parallel when one key is huge.

A window partitioned by key hands each key to one task. Keys that hold more than
``CHUNK_ROWS`` rows are therefore counted first and cut into chunks along the
ordering column, at quantiles of the key's own rows, so a chunk has about
``CHUNK_ROWS`` rows however dense or sparse the order is. Each chunk is a window of
its own; what it needs from earlier chunks comes from one summary row per chunk.
The ordering column, with ``ties``, must be unique within a key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgertree.session import materialize

CHUNK_ROWS = 4_000_000

_CHUNK = "_chunk"


def hot_keys(df: DataFrame, keys: Sequence[str], over: int) -> DataFrame | None:
    """(*keys, n) of all keys with more than ``over`` rows, or None if there are none.

    Exact: counts combine on the map side, and the hot keys are kept as a table.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > over)
    hot = materialize(counts, "hot-keys")
    return None if hot.isEmpty() else hot


def join_unique(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", over: int = CHUNK_ROWS
) -> DataFrame:
    """Join with a side that is unique by ``keys`` and whose result is grouped by them next.

    There the adaptive skew join does not split a hot key, since that would cost
    another shuffle. Rows of hot keys are joined apart from the rest, spread by a
    salt for which the unique side, which has one row for each, is repeated.
    """
    hot = hot_keys(left, keys, over)
    if hot is None:
        return left.join(right, list(keys), how)
    keys = list(keys)
    salts = (F.floor(F.col("n") / over) + 1).cast("int")
    calm = left.join(hot, keys, "left_anti").join(right, keys, how)
    # A random salt decides only where a row is joined, never what it meets.
    busy = left.join(hot.select(*keys, salts.alias("_salts")), keys)
    busy = busy.withColumn("_salt", F.floor(F.rand(7) * F.col("_salts")).cast("int")).drop("_salts")
    wide = right.join(hot.select(*keys, salts.alias("_salts")), keys)
    wide = wide.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return calm.unionByName(busy.join(wide, [*keys, "_salt"], how).drop("_salt"))


class Ordered:
    """Rows of a table, to be looked back on along ``order`` within ``keys``.

    ``counted`` is where to look for hot keys when ``df`` itself is costly: any
    table with the same keys, the same ``order`` column if it has one, and about as
    many rows for each. ``ties`` order the rows of one ``order`` value.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: str,
        chunk_rows: int = CHUNK_ROWS,
        counted: DataFrame | None = None,
        ties: Sequence[str] = (),
    ):
        self.keys, self.order, self.ties = list(keys), order, list(ties)
        counted = df if counted is None else counted
        hot = hot_keys(counted, self.keys, chunk_rows)
        self.split = hot is not None
        if hot is not None:
            df = self._chunked(df, hot, counted if order in counted.columns else df, chunk_rows)
        self.df = df

    def _chunked(self, df: DataFrame, hot: DataFrame, counted: DataFrame, chunk_rows: int) -> DataFrame:
        """``df`` with the chunk of each row of a hot key, NULL for the others."""
        most = hot.agg(F.max("n")).first()[0]
        pieces = max(2, -(-most // chunk_rows))
        at = [i / pieces for i in range(1, pieces)]
        cuts = (
            counted.join(hot.select(*self.keys), self.keys, "left_semi")
            .groupBy(*self.keys)
            .agg(F.percentile_approx(self.order, at, 20 * pieces).alias("_cuts"))
        )
        cuts = materialize(cuts, "hot-cuts")
        chunk = F.size(F.filter("_cuts", lambda c: c < F.col(self.order))).cast("long")
        marked = df.join(cuts, self.keys, "left")
        return marked.withColumn(_CHUNK, F.when(F.col("_cuts").isNotNull(), chunk)).drop("_cuts")

    def then(self, change: Callable[[DataFrame], DataFrame]) -> "Ordered":
        """The same rows after a row-wise change; it must keep all columns."""
        out = object.__new__(Ordered)
        out.keys, out.order, out.ties, out.split = self.keys, self.order, self.ties, self.split
        out.df = change(self.df)
        return out

    def look_back(
        self, last: Mapping[str, Column] | None = None, total: Mapping[str, Column] | None = None
    ) -> "Ordered":
        """Add columns computed from the strictly earlier rows of the same key.

        ``last``: the latest non-null value of the expression, else NULL.
        ``total``: the sum of the expression, else 0.
        """
        last, total = dict(last or {}), dict(total or {})
        return self.then(lambda df: self._across(df, last, total) if self.split else self._within(df, self.keys, last, total))

    def _within(self, df: DataFrame, by: list[str], last: dict, total: dict) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(self.order, *self.ties).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(
            "*",
            *[F.last(expr, ignorenulls=True).over(w).alias(name) for name, expr in last.items()],
            *[F.coalesce(F.sum(expr).over(w), F.lit(0)).alias(name) for name, expr in total.items()],
        )

    def _across(self, df: DataFrame, last: dict, total: dict) -> DataFrame:
        keys, order = self.keys, F.struct(self.order, *self.ties)
        near = self._within(df, [*keys, _CHUNK], last, total)
        # One row per chunk of a hot key.
        chunks = (
            df.filter(F.col(_CHUNK).isNotNull())
            .groupBy(*keys, _CHUNK)
            .agg(
                *[F.max_by(expr, F.when(expr.isNotNull(), order)).alias("_in_" + n) for n, expr in last.items()],
                *[F.sum(expr).alias("_in_" + n) for n, expr in total.items()],
            )
        )
        before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carried = chunks.select(
            *keys,
            _CHUNK,
            *[F.last("_in_" + n, ignorenulls=True).over(before).alias("_in_" + n) for n in last],
            *[F.sum("_in_" + n).over(before).alias("_in_" + n) for n in total],
        )
        return near.join(carried, [*keys, _CHUNK], "left").select(
            *df.columns,
            *[F.coalesce(F.col(n), F.col("_in_" + n)).alias(n) for n in last],
            *[(F.col(n) + F.coalesce(F.col("_in_" + n), F.lit(0))).alias(n) for n in total],
        )


def as_of(
    left: DataFrame,
    right: DataFrame,
    left_on: tuple[str | Sequence[str], str],
    right_on: tuple[str | Sequence[str], str],
    name: str,
    forward: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Each row of ``left`` with the nearest row of ``right`` at or before its time.

    ``left_on`` and ``right_on`` are (key, time), or (several keys, time) where one
    column does not identify the thing, as a process id on several machines. The found row is the struct
    ``name``, NULL when there is none; ``forward`` looks for the nearest at or
    after instead. Both sides are merged in time order, so no pairs arise however
    often a key recurs.
    """

    def shaped(df: DataFrame, on: tuple[str, str], side: str, late: int) -> DataFrame:
        micros = F.unix_micros(on[1]) * (-2 if forward else 2) + late
        parts = [on[0]] if isinstance(on[0], str) else list(on[0])
        key = F.struct(*[F.col(p).alias(f"k{i}") for i, p in enumerate(parts)])
        return df.select(key.alias("_key"), micros.alias("_at"), F.struct(*df.columns).alias(side))

    asking, offered = shaped(left, left_on, "_asking", 1), shaped(right, right_on, "_offered", 0)
    both = asking.unionByName(offered, allowMissingColumns=True)
    counted = both.select("_key", "_at")
    rows = Ordered(both, ["_key"], "_at", chunk_rows, counted).look_back(last={name: F.col("_offered")})
    return rows.df.filter("_asking is not null").select("_asking.*", name)
