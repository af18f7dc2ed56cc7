"""Rules a record has to keep, the issues where it doesn't, and repairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISSUE = "struct<field:string,kind:string,severity:string,message:string>"
#: Fields every assembled record has; fixed values.
REQUIRED = ("title", "type", "status", "sources", "episodes", "enrichment_metadata", "characters", "staff_data")


@dataclass(frozen=True)
class Rule:
    field: str
    kind: str
    severity: str
    broken: Column
    message: str

    def issue(self) -> Column:
        parts = [F.lit(x).alias(n) for n, x in (("field", self.field), ("kind", self.kind), ("severity", self.severity), ("message", self.message))]
        return F.when(F.coalesce(self.broken, F.lit(False)), F.struct(*parts))


def required(*fields: str) -> list[Rule]:
    return [Rule(f, "missing", "error", F.col(f).isNull(), f"{f} is required") for f in fields]


def empties(schema: T.StructType, skip: tuple[str, ...] = ()) -> list[Rule]:
    """Warnings for empty collections, notes for null scalars."""
    rules = []
    for f in schema.fields:
        if f.name in skip:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType)):
            rules.append(Rule(f.name, "empty_collection", "warning", F.size(c) == 0, f"{f.name} is empty"))
        elif isinstance(f.dataType, T.StructType):
            rules.append(Rule(f.name, "empty_object", "warning", c.isNotNull() & F.array_min(F.array(*[c.getField(g.name).isNull() for g in f.dataType.fields])), f"{f.name} has no value"))
        else:
            rules.append(Rule(f.name, "null_scalar", "info", c.isNull(), f"{f.name} is null"))
    return rules


def one_of(field: str, *values: str) -> Rule:
    return Rule(field, "schema", "error", ~F.col(field).isin(*values), f"{field} is none of its values")


def voice_actors(field: str = "voice_actors") -> list[Rule]:
    c = F.col(field)
    return [
        Rule(field, "voice_actor", "error", F.exists(c, lambda v: F.length(F.trim(F.coalesce(v["name"], F.lit("")))) == 0), "a voice actor has no name"),
        Rule(field, "voice_actor", "warning", F.exists(c, lambda v: v["language"].isNull()), "a voice actor has no language"),
    ]


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows with their issues and number of errors: one projection, no shuffle."""
    issues = F.filter(F.array(*[r.issue() for r in rules]).cast(f"array<{ISSUE}>"), lambda i: i.isNotNull())
    return df.withColumn("issues", issues).withColumn("errors", F.size(F.filter("issues", lambda i: i["severity"] == "error")))


def exploded(validated: DataFrame, id_col: str) -> DataFrame:
    return validated.select(id_col, F.explode("issues").alias("i")).select(id_col, "i.field", "i.kind", "i.severity", "i.message")


def auto_fix(df: DataFrame, domains: dict[str, tuple[tuple[str, ...], str]] | None = None) -> DataFrame:
    """Empty collections become null, strings are trimmed and blank ones null, unknown values the default; ``fixes`` names the fields."""
    fixed, notes = [], []
    for f in df.schema.fields:
        c = new = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType)):
            new = F.when(F.size(c) > 0, c)
        elif isinstance(f.dataType, T.StringType):
            new = F.nullif(F.trim(c), F.lit(""))
            if domains and f.name in domains:
                values, default = domains[f.name]
                new = F.when(new.isin(*values), new).otherwise(F.lit(default))
        fixed.append(new.alias(f.name))
        if not isinstance(f.dataType, T.MapType):
            notes.append(F.when(~new.eqNullSafe(c), F.lit(f.name)))
    return df.select(*fixed, F.filter(F.array(*notes), lambda n: n.isNotNull()).alias("fixes"))


def validate_and_fix(df: DataFrame, rules: list[Rule], domains: dict[str, tuple[tuple[str, ...], str]] | None = None) -> DataFrame:
    """Fixed rows validated again."""
    return validate(auto_fix(df, domains), rules)


def schema_difference(a: T.StructType, b: T.StructType) -> dict[str, list[str]]:
    """Fields only one of two schemas has."""
    x, y = set(a.fieldNames()), set(b.fieldNames())
    return {"only_first": sorted(x - y), "only_second": sorted(y - x)}
