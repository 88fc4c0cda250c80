"""Strata, stratified samples and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def categorical(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Stratum number from 1 in the order of the values; nulls form the last stratum."""
    return joint(df, [column], name or f"strata|{column}")


def joint(df: DataFrame, columns: Sequence[str], name: str = "strata|joint") -> DataFrame:
    """Stratum number from 1 of each combination of values that occurs.

    The numbering sorts the distinct combinations, not the rows.
    """
    key = {c: f"_k{i}" for i, c in enumerate(columns)}
    kinds = df.select(*[F.col(f"`{c}`").alias(k) for c, k in key.items()]).distinct()
    numbered = kinds.withColumn(name, F.row_number().over(Window.orderBy(*[F.asc_nulls_last(k) for k in key.values()])))
    on = [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in key.items()]
    return df.join(numbered, on, "left").drop(*key.values())


def real(df: DataFrame, column: str, low: float, high: float, bins: int, name: str | None = None) -> DataFrame:
    """Equal-width bins 1..bins over [low, high); 0 and bins + 1 beyond; null for null."""
    return df.withColumn(name or f"strata|{column}", F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)))


def quantile(df: DataFrame, column: str, bins: int, name: str | None = None) -> DataFrame:
    """Bins of equal frequency by exact quantiles of all rows; equal values share a bin."""
    cuts = df.select(F.percentile(F.col(column), [i / bins for i in range(1, bins)])).first()[0] or []
    number = F.lit(1)
    for c in cuts:
        number = number + (F.col(column) > F.lit(float(c))).cast("int")
    return df.withColumn(name or f"strata|{column}", number)


def episodic(df: DataFrame, column: str, unit: str = "day", name: str | None = None) -> DataFrame:
    """The period (date_trunc unit) of a timestamp."""
    return df.withColumn(name or f"strata|{column}", F.date_trunc(unit, F.col(column).cast("timestamp")))


def embedded(df: DataFrame, clusters: DataFrame, key: str, label: str = "cluster", name: str = "strata|embedding") -> DataFrame:
    """Cluster labels as strata."""
    return df.join(clusters.select(key, F.col(label).alias(name)), key, "left")


def create_strata(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """By the column's type: time by day, fractions by quantiles, vectors rejected (see `embedded`), all else by value."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return episodic(df, column)
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return quantile(df, column, bins)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise TypeError(f"{column} needs clusters for strata")
    return categorical(df, column)


def create_stratas(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    for c in columns:
        df = create_strata(df, c, bins)
    return df


def placed(df: DataFrame, columns: Sequence[str], key: str, seed: int) -> DataFrame:
    """Adds `_place`, 1.. within each stratum in the order of a seeded digest of the key.

    A stratum is cut into 256 ranges of the digest, so that a large one is many tasks' work: the place in
    the range, and the rows of the ranges before it.
    """
    cut = df.withColumn("_digest", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))).withColumn("_range", F.substring("_digest", 1, 2))
    names = [f"_k{i}" for i in range(len(columns))]
    sizes = cut.groupBy(*[F.col(f"`{c}`").alias(k) for c, k in zip(columns, names, strict=True)], F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*names).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    on = [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(columns, names, strict=True)]
    joined = cut.join(sizes, [*on, F.col("_range") == F.col("_r")])
    within = F.row_number().over(Window.partitionBy(*names, "_range").orderBy("_digest", key))
    return joined.withColumn("_place", F.col("_before") + within).drop("_digest", "_range", "_r", "_n", "_before", *names)


def stratified_sample(df: DataFrame, columns: Sequence[str], n: int, key: str, seed: int = 0) -> DataFrame:
    """About n rows, each stratum in proportion (rounded up), chosen by a seeded hash of the key."""
    size = df.groupBy(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(columns)]).agg(F.count("*").alias("_size"))
    total = df.agg(F.count("*").alias("_total"))
    ranked = placed(df, columns, key, seed)
    joined = ranked.join(size, [F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(columns)]).crossJoin(F.broadcast(total))  # one row
    return joined.filter(F.col("_place") <= F.ceil(F.col("_size") * n / F.col("_total"))).select(*[f"`{c}`" for c in df.columns])


def stratified_folds(df: DataFrame, columns: Sequence[str], folds: int, key: str, seed: int = 0) -> DataFrame:
    """Adds `fold`, 0..folds-1, evenly within each stratum."""
    return placed(df, columns, key, seed).withColumn("fold", ((F.col("_place") - 1) % folds).cast("int")).drop("_place")
