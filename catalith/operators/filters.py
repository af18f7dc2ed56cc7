"""Filter conditions as predicates: must, must_not and should clauses over scalars, arrays and dotted paths.

A missing value matches no condition, so ``must_not`` keeps rows without the field.  On arrays a condition holds if
some element fulfils it.  Predicates are plain Columns: Catalyst pushes them into the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.operators.contracts import Condition, Range


def field_column(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    """The column of a dotted path through structs and maps, with its type."""
    head, *rest = path.split(".")
    column, kind = F.col(f"`{head}`"), df.schema[head].dataType
    for key in rest:
        if isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(key)), kind.valueType
        elif isinstance(kind, T.StructType):
            column, kind = column.getField(key), kind[key].dataType
        else:
            raise ValueError(f"{path} leads through a plain value")
    return column, kind


def _test(x: Column, operator: str, value: object) -> Column:
    if operator == "eq":
        return x == F.lit(value)
    if operator == "ne":
        return x != F.lit(value)
    if operator == "in":
        return x.isin(*value)
    if operator == "not_in":
        return ~x.isin(*value)
    bounds = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}
    assert isinstance(value, Range)
    return reduce(lambda a, b: a & b, [bounds[k](x, F.lit(v)) for k in bounds if (v := getattr(value, k)) is not None])


def condition_column(df: DataFrame, c: Condition) -> Column:
    """The test of one condition; null where the field is missing, which a filter takes as false and pushes down as it is."""
    column, kind = field_column(df, c.field)
    if isinstance(kind, T.ArrayType):
        return F.exists(column, lambda x: _test(x, c.operator, c.value))
    return _test(column, c.operator, c.value)


def filter_column(df: DataFrame, conditions: list[Condition] | tuple[Condition, ...]) -> Column | None:
    """All of must, none of must_not, at least one of should; None for no conditions."""
    by = {k: [condition_column(df, c) for c in conditions if c.clause == k] for k in ("must", "must_not", "should")}
    parts = by["must"] + [~F.coalesce(x, F.lit(False)) for x in by["must_not"]] + ([reduce(lambda a, b: a | b, by["should"])] if by["should"] else [])
    return reduce(lambda a, b: a & b, parts) if parts else None


def apply_filters(df: DataFrame, conditions: list[Condition] | tuple[Condition, ...]) -> DataFrame:
    predicate = filter_column(df, conditions)
    return df if predicate is None else df.filter(predicate)


def title_contains(df: DataFrame, phrase: str, column: str = "title") -> DataFrame:
    return df.filter(F.lower(F.col(column)).contains(phrase.lower()))


def scroll(df: DataFrame, limit: int, after: object = None, id_col: str = "id", conditions: tuple[Condition, ...] = (), vectors: tuple[str, ...] = (), with_vectors: bool = False) -> DataFrame:
    """One page in order of the id, behind the cursor ``after`` (the last id of the page before)."""
    page = apply_filters(df if with_vectors else df.drop(*vectors), conditions)
    return (page if after is None else page.filter(F.col(id_col) > F.lit(after))).orderBy(id_col).limit(limit)
