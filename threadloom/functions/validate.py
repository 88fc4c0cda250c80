"""Validators of typed values as boolean columns (null where the value itself is null)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.tokens import DEFAULT, Tokenizer

MAX_TOKENS = 8000


def text(value: Column, max_tokens: int = MAX_TOKENS, tokenizer: Tokenizer = DEFAULT) -> Column:
    return tokenizer.count(value) <= max_tokens


def text_list(values: Column, max_tokens: int = MAX_TOKENS, tokenizer: Tokenizer = DEFAULT) -> Column:
    return F.forall(values, lambda v: text(v, max_tokens, tokenizer))


def discrete(value: Column, alphabet: Column | Sequence | None = None) -> Column:
    """The value is in the alphabet; without one anything goes."""
    if alphabet is None:
        return F.when(value.isNotNull(), True)
    if not isinstance(alphabet, Column):
        return value.isin(list(alphabet))
    return F.when(alphabet.isNull(), value.isNotNull()).otherwise(F.array_contains(alphabet, value))


def discrete_list(items: Column, alphabet: Column | Sequence) -> Column:
    """Items are structs with `alphabet`: each is a part of the list's alphabet."""
    whole = alphabet if isinstance(alphabet, Column) else F.array(*[F.lit(a) for a in alphabet])
    return F.forall(items, lambda i: F.size(F.array_except(i["alphabet"], whole)) == 0)


def n_discrete(items: Column) -> Column:
    """At least two dimensions."""
    return F.size(items) >= 2


def dimension_types(items: Column) -> Column:
    """The items' `kind` fields by position, as one text."""
    return F.concat_ws(",", F.transform(items, lambda i: i["kind"]))


def n_discrete_list(values: Column, joint_alphabet: Column | None = None) -> Column:
    """Arrays of structs (kind, alphabet): equal type dictionaries; each tuple of the joint alphabet has that arity and respects the alphabets by position."""
    same = (F.size(F.array_distinct(F.transform(values, dimension_types))) <= 1) & F.forall(values, n_discrete)
    if joint_alphabet is None:
        return same
    first = F.get(values, F.lit(0))
    allowed = lambda t: F.forall(F.zip_with(t, first, lambda x, d: d["alphabet"].isNull() | F.array_contains(d["alphabet"], x)), lambda ok: F.coalesce(ok, F.lit(False)))
    return same & F.forall(joint_alphabet, lambda t: (F.size(t) == F.size(first)) & allowed(t))


def real(value: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """low <= value <= high; a missing bound is none."""
    if low is None and high is None:
        return F.when(value.isNotNull(), True)
    low, high = (b if isinstance(b, Column) else F.lit(b).cast("double") for b in (low, high))
    return F.when(value.isNotNull(), (low.isNull() | (value >= low)) & (high.isNull() | (value <= high)))


def real_list(values: Column, low: Column | float, high: Column | float) -> Column:
    return F.forall(values, lambda v: real(v, low, high))


def n_real(values: Column, ranges: Column | Sequence[tuple[float, float]] | tuple[float, float] | None = None) -> Column:
    """One (low, high) for all dimensions, or one for each (then as many as dimensions); a Column holds an array of structs (low, high)."""
    if ranges is None:
        return F.when(values.isNotNull(), True)
    if isinstance(ranges, tuple) and len(ranges) == 2 and not isinstance(ranges[0], tuple):
        return real_list(values, *ranges)
    if not isinstance(ranges, Column):
        ranges = F.array(*[F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for a, b in ranges])
    fits = F.forall(F.zip_with(values, ranges, lambda v, r: F.coalesce(real(v, r["low"], r["high"]), F.lit(False))), lambda ok: ok)
    return (F.size(values) == F.size(ranges)) & fits


def n_real_list(rows: Column, ranges: Column | Sequence[tuple[float, float]] | tuple[float, float] | None = None) -> Column:
    """Arrays of equal length within the ranges; lengths are compared only when there are ranges."""
    if ranges is None:
        return F.when(rows.isNotNull(), True)
    return (F.size(F.array_distinct(F.transform(rows, F.size))) <= 1) & F.forall(rows, lambda r: n_real(r, ranges))


def header(df: DataFrame, source: str = "unknown", name: str = "data", elements: str = "elements") -> DataFrame:
    """Adds the descriptive fields of a typed value where they are missing: source, timestamp, id, data_name, elements_name."""
    defaults = {"source": F.lit(source), "timestamp": F.current_timestamp(), "id": F.uuid(), "data_name": F.lit(name), "elements_name": F.lit(elements)}
    for c, d in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), d) if c in df.columns else d)
    return df


def checked(df: DataFrame, column: str, validator: Callable[[Column], Column], embeddable: Sequence[str] | None = None, fail: bool = True) -> DataFrame:
    """The frame, raising at the first invalid value of the column; with fail=False it gets `<column>_valid` instead."""
    if embeddable is not None and column not in embeddable:
        raise ValueError(f"{column} is not embeddable")
    ok = F.coalesce(validator(F.col(f"`{column}`")), F.lit(False))
    if not fail:
        return df.withColumn(f"{column}_valid", ok)
    return df.withColumn(column, F.when(ok, F.col(f"`{column}`")).otherwise(F.raise_error(F.concat(F.lit(f"invalid {column}: "), F.col(f"`{column}`").cast("string")))))
