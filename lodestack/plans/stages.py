"""Running named stages over written tables, from any stage on, and resuming by what is done."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def run(spark: SparkSession, source: DataFrame, stages: Sequence[Stage], folder: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Runs stages in order, each over what the one before has written under ``folder``; from ``first`` to ``last``."""
    names = [name for name, _ in stages]
    if first is not None and first not in names or last is not None and last not in names:
        raise ValueError(f"no stage {first if first not in names else last}; there are {names}")
    begin, end = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
    if begin > end:
        raise ValueError(f"{first} comes after {last}")
    df = source if not begin else spark.read.parquet(f"{folder}/{names[begin - 1]}")
    for name, stage in stages[begin : end + 1]:
        stage(df).write.mode("overwrite").parquet(f"{folder}/{name}")
        df = spark.read.parquet(f"{folder}/{name}")
    return df


def pending(items: DataFrame, done: DataFrame, key: str, wanted: Sequence | None = None, most: int | None = None) -> DataFrame:
    """Items not done yet, of those wanted if any are named; a name that no item has is an error."""
    if wanted is not None:
        named = items.where(items[key].isin(*wanted))
        unknown = set(wanted) - {r[0] for r in named.select(key).distinct().collect()}  # as many as were named
        if unknown:
            raise ValueError(f"unknown: {sorted(unknown)}")
        items = named
    left = items.join(done.select(key), key, "left_anti")
    return left if most is None else left.orderBy(key).limit(most)
