"""Arrays, maps and nested values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_strings(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (F.length(F.trim(v)) > 0))


def distinct_ignoring_case(*lists: Column) -> Column:
    """Trimmed values of all lists in order, the first spelling of each kept."""
    joined = F.concat(*[F.coalesce(clean_strings(x), F.array().cast("array<string>")) for x in lists])
    trimmed = F.transform(joined, lambda v: F.trim(v))
    kept = F.aggregate(
        trimmed,
        F.array().cast("array<struct<key:string,value:string>>"),
        lambda acc, v: F.when(F.array_contains(F.transform(acc, lambda k: k["key"]), F.lower(v)), acc).otherwise(F.concat(acc, F.array(F.struct(F.lower(v).alias("key"), v.alias("value"))))),
    )
    return F.transform(kept, lambda k: k["value"])


def ordered_distinct(*lists: Column) -> Column:
    return F.array_distinct(clean_strings(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])))


def sorted_union(a: Column, b: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))


def nickname_distinct(names: Column) -> Column:
    """Without repeats in other case, and of `X` and `X (note)` the longer only."""
    once = distinct_ignoring_case(names)
    return F.filter(once, lambda v: ~F.exists(once, lambda w: F.lower(w).startswith(F.concat(F.lower(v), F.lit(" (")))))


def episode_ranges(text: Column) -> Column:
    """`1-30, 492, 1139-` as start and end; an open range has no end."""
    item = r"^\s*(\d+)\s*(-?)\s*(\d*)\s*$"
    parts = F.filter(F.split(F.regexp_replace(text, r"(?i)\b(?:eps?|episodes?)\b\.?", ""), ","), lambda p: p.rlike(item))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, item, 1).cast("int").alias("start"),
            F.when(F.regexp_extract(p, item, 2) == "", F.regexp_extract(p, item, 1).cast("int")).otherwise(F.regexp_extract(p, item, 3).try_cast("int")).alias("end"),
        ),
    )


def theme_song(text: Column) -> Column:
    """Title, artist and episodes of `1: "Title" by Artist (eps 1-12)`; a bare text is a title."""
    t = F.trim(F.regexp_replace(text, r"^\s*#?\d+:\s*", ""))
    quoted, plain = r'^"([^"]+)"(?:\s+by\s+(.+?))?(?:\s*\(eps?\s+([^)]*)\))?$', r"^(.+?)\s+by\s+(.+?)(?:\s*\(eps?\s+([^)]*)\))?$"
    part = lambda p, i: F.nullif(F.regexp_extract(t, p, i), F.lit(""))
    either = lambda i: F.when(t.rlike(quoted), part(quoted, i)).when(t.rlike(plain), part(plain, i))
    return F.struct(F.coalesce(either(1), t).alias("title"), either(2).alias("artist"), either(3).alias("episodes"))


def same_multiset(a: Column, b: Column) -> Column:
    """Equal values; lists are equal in any order."""
    return F.array_sort(F.transform(a, lambda x: x.cast("string"))).eqNullSafe(F.array_sort(F.transform(b, lambda x: x.cast("string"))))


def changed_fields(pairs: dict[str, tuple[Column, Column, bool]]) -> Column:
    """Names of the fields whose old and new value differ; the flag tells lists."""
    tests = [F.when(~(same_multiset(a, b) if is_list else a.eqNullSafe(b)), F.lit(name)) for name, (a, b, is_list) in pairs.items()]
    return F.filter(F.array(*tests), lambda n: n.isNotNull())


def first_sound(*values: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def drop_null_entries(entries: dict[str, Column]) -> Column:
    """A map of those entries that have a value."""
    return F.map_filter(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
