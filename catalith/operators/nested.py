"""Deeply nested records turned into flat tables by Dewey labels.

Every repeated thing in a document (an *entity*) gets the label of its parent followed by its own ordinal among the
siblings of its schema path, counted in written order.  The parent of a node is found by cutting the last ordinal off,
and a table is all nodes of one schema path: no join and no shuffle is needed to build or to relate the tables.

Sources write one thing in many shapes, so the walk is told by ``Layout`` which fields repeat.  A single object or
scalar stands for a list of one, an object whose keys are all numbers for the list of its values, JSON inside a string
for what it holds; envelopes (``data``), objects wrapped around repeated fields at any level, and blocks (an item that
only carries the next level of the same field) are looked through, and ordinals run on over them.  Null items are no entities.

Cases: a payload that is null, blank or not whole JSON gives no row at all (``corrupt`` counts them); an empty object
gives only its root row; a byte order mark is ignored; blank strings are kept as values; repeated documents give
repeated rows; of a key written twice the last counts; documents nested deeper than the parser allows count as not
whole.  Columns other than the two named ones are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.runtime import require


@dataclass(frozen=True)
class Repeat:
    """A field that repeats: the entity its items are, and the pattern that splits a plain string of several items."""

    entity: str
    fields: dict[str, Repeat] = field(default_factory=dict)
    split: str | None = None


@dataclass(frozen=True)
class Layout:
    repeats: dict[str, Repeat]
    envelopes: tuple[str, ...] = ("data",)


_RANGES = Repeat("theme_range", split=r"\s*[,;]\s*")
_EPISODE = Repeat("episode", {"characters": Repeat("character", {"voice_actors": Repeat("voice_actor")})})
#: Pages of a catalogue: episodes with characters with voice actors, theme songs with episode ranges.
PAGE_LAYOUT = Layout(
    {
        "episodes_raw": _EPISODE,
        "opening_themes": Repeat("opening_theme", {"episodes": _RANGES}),
        "ending_themes": Repeat("ending_theme", {"episodes": _RANGES}),
    }
)
NODE = "id bigint, path string, label array<int>, fields map<string,string>"


def _scalar(x: Any) -> str | None:
    return None if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x)


def _decoded(x: Any) -> Any:
    """What JSON inside a string holds; the string itself where it holds none."""
    if isinstance(x, str) and x.strip()[:1] in ("[", "{"):
        try:
            return json.loads(x, parse_int=str, parse_float=str)
        except (ValueError, RecursionError):
            pass
    return x


def _items(x: Any, split: str | None) -> list[Any]:
    x = _decoded(x)
    if isinstance(x, dict):
        return list(x.values()) if x and all(k.isdigit() for k in x) else [x]
    if isinstance(x, list):
        return x
    if isinstance(x, str):
        return [p for p in re.split(split, x.strip()) if p] if split else [x]
    return [] if x is None else [x]


class _Walk:
    def __init__(self, layout: Layout):
        self.layout, self.rows, self.counts = layout, [], {}

    def entity(self, x: Any, rule: Repeat, path: str, label: tuple[int, ...], name: str) -> None:
        x = _decoded(x)
        if x is None:
            return
        if isinstance(x, dict):
            inner = next((k for k in x if name.startswith(k)), None)
            if inner is not None and inner not in rule.fields:  # a block: its items are siblings of those outside
                for y in _items(x[inner], rule.split):
                    self.entity(y, rule, path, label, name)
                return
        own = f"{path}.{rule.entity}" if path else rule.entity
        n = self.counts.get((label, own), 0)
        self.counts[label, own] = n + 1
        at = (*label, n)
        values: dict[str, str | None] = {}
        self.rows.append((own, at, values))
        self.fields(x, rule.fields, own, at, values, "")

    def fields(self, x: Any, repeats: dict[str, Repeat], path: str, label: tuple[int, ...], values: dict[str, str | None], prefix: str) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                if k in repeats:
                    for y in _items(v, repeats[k].split):
                        self.entity(y, repeats[k], path, label, k)
                elif isinstance(v, (dict, list)):
                    self.fields(v, repeats if isinstance(v, dict) else {}, path, label, values, f"{prefix}{k}.")
                else:
                    values[prefix + k] = _scalar(v)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                if isinstance(v, (dict, list)):
                    self.fields(v, {}, path, label, values, f"{prefix}{i}.")
                else:
                    values[f"{prefix}{i}"] = _scalar(v)
        else:
            values[prefix] = _scalar(x)

    def document(self, x: Any) -> None:
        """Look through envelopes down to the documents; several documents of one payload share their ordinals."""
        x = _decoded(x)
        if isinstance(x, list):
            for y in x:
                self.document(y)
        elif isinstance(x, dict):
            inner = next((e for e in self.layout.envelopes if isinstance(x.get(e), (dict, list, str))), None)
            if inner is not None and not any(k in self.layout.repeats for k in x):
                self.document(x[inner])
                return
            values: dict[str, str | None] = {}
            self.rows.append(("", (), values))
            self.fields(x, self.layout.repeats, "", (), values, "")


def label_document(payload: str | None, layout: Layout = PAGE_LAYOUT) -> list[tuple[str, tuple[int, ...], dict[str, str | None]]] | None:
    """(schema path, label, scalar fields) of every entity of one payload; None where it is not whole."""
    if payload is None or not payload.strip("﻿ \t\r\n"):
        return None
    try:
        x = json.loads(payload.lstrip("﻿"), parse_int=str, parse_float=str)
        if isinstance(x, str):  # the whole document inside a string
            x = json.loads(x.lstrip("﻿"), parse_int=str, parse_float=str)
        walk = _Walk(layout)
        walk.document(x)
    except (ValueError, RecursionError):
        return None
    return walk.rows


def dewey_nodes(pages: DataFrame, id_col: str = "page_id", payload_col: str = "payload", layout: Layout = PAGE_LAYOUT) -> DataFrame:
    """One row per entity: id, schema path, Dewey label, scalar fields (nested ones under dotted names)."""
    require(pages, id_col, payload_col)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, path, list(at), values) for i, p in zip(b["id"], b["payload"]) for path, at, values in label_document(p, layout) or ()]
            for k in range(0, max(1, len(rows)), 20_000):
                yield pd.DataFrame(rows[k : k + 20_000], columns=["id", "path", "label", "fields"])

    return pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(payload_col).alias("payload")).mapInPandas(walk, NODE)


def node_table(nodes: DataFrame, path: str, columns: dict[str, str]) -> DataFrame:
    """The flat table of one schema path: id, label, parent_label and the chosen fields under their new names."""
    return nodes.filter(F.col("path") == path).select(
        "id", "label", F.slice("label", 1, F.size("label") - 1).alias("parent_label"), *[F.col("fields")[source].alias(name) for name, source in columns.items()]
    )


def episode_range(fields: Column) -> Column:
    """`start-end` of an episode range written as an object, a pair, a number or text; `start-` where it is open."""
    text, dash = F.trim(fields[""]), r"^(\d+)\s*[-–—~]\s*(\d*)$"
    start = F.coalesce(fields["start"], fields["0"], F.nullif(F.regexp_extract(text, dash, 1), F.lit("")), F.when(text.rlike(r"^\d+$"), text))
    end = F.coalesce(fields["end"], fields["1"], F.nullif(F.regexp_extract(text, dash, 2), F.lit("")), F.when(text.rlike(r"^\d+$"), text))
    return F.when(F.trim(start).rlike(r"^\d+$"), F.concat(F.trim(start), F.lit("-"), F.coalesce(F.trim(end), F.lit(""))))


def page_tables(pages: DataFrame) -> DataFrame:
    """Titles of episodes, voice actors and theme ranges of catalogue pages, with their positions (-1 where unused)."""
    nodes = dewey_nodes(pages)
    name = F.coalesce(F.col("fields")["name"], F.col("fields")["person.name"], F.col("fields")[""])
    path, at = F.col("path"), lambda i: F.coalesce(F.try_element_at("label", F.lit(i)), F.lit(-1))
    child = (
        F.when(path == "episode", "episode_title").when(path == "episode.character.voice_actor", "voice_actor").when(path.endswith(".theme_range"), "theme_range")
    )
    leaf = F.when(path == "episode", F.col("fields")["title_en"]).when(path == "episode.character.voice_actor", name).otherwise(episode_range(F.col("fields")))
    themed = path.endswith(".theme_range")
    return (
        nodes.select(
            F.col("id").alias("page_id"),
            child.alias("child"),
            F.when(themed, F.when(path.startswith("opening"), 0).otherwise(1)).otherwise(at(1)).cast("int").alias("ord1"),
            F.when(themed, at(1)).otherwise(at(2)).cast("int").alias("ord2"),
            F.when(themed, at(2)).otherwise(at(3)).cast("int").alias("ord3"),
            leaf.alias("leaf"),
        )
        .filter(F.col("child").isNotNull() & (F.length(F.trim("leaf")) > 0))
    )
