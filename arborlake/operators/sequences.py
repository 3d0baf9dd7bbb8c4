"""Operators on ordered rows. Each takes the columns of its partitions, so rows are only sorted inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(partition: list[str], order: list) -> Window:
    return Window.partitionBy(*partition).orderBy(*order)


def runs(df: DataFrame, value: Column, partition: list[str], order: list, name: str = "run") -> DataFrame:
    """Numbers the runs of rows with equal ``value`` (nulls are equal), from 1."""
    w = _window(partition, order)
    changed = F.when(F.row_number().over(w) == 1, 1).when(value.eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return df.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def _prefix(holds: Column, partition: list[str], order: list) -> Column:
    w = _window(partition, order).rowsBetween(Window.unboundedPreceding, 0)
    return F.min(F.coalesce(holds, F.lit(False)).cast("int")).over(w)


def take_while(df: DataFrame, holds: Column, partition: list[str], order: list) -> DataFrame:
    return df.withColumn("_in", _prefix(holds, partition, order)).where("_in = 1").drop("_in")


def drop_while(df: DataFrame, holds: Column, partition: list[str], order: list) -> DataFrame:
    return df.withColumn("_in", _prefix(holds, partition, order)).where("_in = 0").drop("_in")


def next_sibling(df: DataFrame, is_header: Column, partition: list[str], order: list, position: str, name: str = "next_header") -> DataFrame:
    """Position of the first header after the run of headers that opens the partition; the same for all its rows."""
    w = _window(partition, order)
    opened = 1 - _prefix(is_header, partition, order)
    df = df.withColumn("_at", F.when((opened == 1) & F.coalesce(is_header, F.lit(False)), F.col(position)))
    return df.withColumn(name, F.min("_at").over(Window.partitionBy(*partition))).drop("_at") if partition else df.withColumn(name, F.min("_at").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("_at")


def number_instances(df: DataFrame, starts: Column, partition: list[str], order: list, name: str) -> DataFrame:
    """Running count of the rows that start an instance (envelopes, loops)."""
    return number_all(df, {name: starts}, partition, order)


def number_all(df: DataFrame, starts: dict[str, Column], partition: list[str], order: list) -> DataFrame:
    """As :func:`number_instances`, several counts (name: what starts it) in one pass over the rows."""
    w = _window(partition, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(w) for name, c in starts.items()})


def at_most_one(df: DataFrame, keys: list[str], value: str, strict: bool = True) -> DataFrame:
    """The one distinct value of each key (null: none). More than one fails the job when the row is used, or, if not strict, gives null and
    sets ``ambiguous``."""
    # one pass: values are distinct where the least isn't the greatest
    g = df.groupBy(*keys).agg(F.min(value).alias("_least"), F.max(value).alias(value)).withColumn("_many", F.coalesce(F.col("_least") != F.col(value), F.lit(False)))
    if not strict:
        return g.select(*keys, F.when(~F.col("_many"), F.col(value)).alias(value), F.col("_many").alias("ambiguous"))
    return g.select(*keys, F.when(F.col("_many"), F.raise_error(F.concat(F.lit("too many values of "), F.lit(value))).cast(df.schema[value].dataType)).otherwise(F.col(value)).alias(value))


def first_known(df: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """The first value by ``order`` that isn't null."""
    return df.groupBy(*keys).agg(F.min_by(F.col(value), F.when(F.col(value).isNotNull(), order)).alias(value))


def last_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by ``order``: a map that is written again and again."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def frequencies(df: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, n): keys that at least so many rows have."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rows_between(df: DataFrame, order: list, start: int, stop: int | None = None) -> DataFrame:
    """Rows start (from 0) up to stop of the whole order."""
    out = df.orderBy(*order).offset(start)
    return out if stop is None else out.limit(max(0, stop - start))


def as_map(df: DataFrame, keys: list[str], key: str, value: str, name: str = "entries") -> DataFrame:
    """One map for each group of rows; of entries with one key the greatest value stays. Null keys are left out."""
    kept = df.where(F.col(key).isNotNull()).groupBy(*keys, key).agg(F.max(value).alias(value))
    return kept.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))
