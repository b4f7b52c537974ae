"""Data-set wide ranges and min-max scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def value_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with <c>_min and <c>_max per column; missing values do not count."""
    return df.agg(*[f(F.col(c)).cast("double").alias(f"{c}_{n}")
                    for c in columns for n, f in (("min", F.min), ("max", F.max))])


def value_ranges_in_order(df: DataFrame, columns: list[str], seq: Column) -> DataFrame:
    """Ranges as they come out of a running update that starts at 0 and 0 in row order ``seq``.

    There, a zero minimum is overwritten by whatever comes next. So a negative minimum stays, and
    otherwise the minimum restarts after the last zero. Two combinable passes, no ordered scan.
    """
    zeros = df.agg(F.struct(*[F.coalesce(F.max(F.when(F.col(c) == 0, seq)), F.lit(-1)).alias(c) for c in columns])
                   .alias("z")).scalar()
    out = []
    for c in columns:
        value = F.col(c).cast("double")
        after = F.min(F.when(seq > zeros[c], value))
        low = F.when(F.min(value) < 0, F.min(value)).otherwise(F.coalesce(after, F.lit(0.0)))
        out += [low.alias(f"{c}_min"), F.greatest(F.max(value), F.lit(0.0)).alias(f"{c}_max")]
    return df.agg(*out)


def scaled(value: Column, low: Column, high: Column) -> Column:
    """0 stays 0; without a spread the value is kept."""
    value = value.cast("double")
    return (F.when(value == 0, F.lit(0.0)).when(high != low, (value - low) / (high - low))
            .otherwise(value))


def normalise(df: DataFrame, ranges: DataFrame, columns: list[str], missing: float = 0.0) -> DataFrame:
    """Replace each column by its scaled value; the one-row ``ranges`` enters as a scalar subquery."""
    r = ranges.select(F.struct("*")).scalar()
    return df.withColumns({
        c: F.coalesce(scaled(F.col(c), r[f"{c}_min"], r[f"{c}_max"]), F.lit(missing)) for c in columns})
