"""Scores, counts, ranks, ids and hashes as Column expressions."""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_score(raw: Column) -> Column:
    """0-100 as 0-10 with two digits; zero stays."""
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.bround(raw.try_cast("double") / 10, 2)))


def scaled_score(raw: Column, factor: float = 1.0) -> Column:
    """Any score times a factor within 0-10, not rounded; zero and what is no number are none."""
    number = F.nullif(raw.cast("string").try_cast("double"), F.lit(0.0))
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), number * factor)))


def parse_number(text: Column) -> Column:
    return F.regexp_replace(text, r"[,#\s]", "").try_cast("bigint")


def first_number(text: Column) -> Column:
    """The first number of `Rank #1,157` or `loved by 3,204`."""
    return F.regexp_replace(F.regexp_extract(text, r"(\d[\d,]*)", 1), ",", "").try_cast("bigint")


def deterministic_id(seed: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The name-based UUID (version 5) of a seed, built from SHA-1 without leaving the JVM; null for a blank seed."""
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(seed, "UTF-8")))
    piece = lambda start, n: F.substring(digest, start, n)
    variant = F.substring(F.lit("89ab"), (F.conv(piece(17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    made = F.concat(piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-5"), piece(14, 3), F.lit("-"), variant, piece(18, 3), F.lit("-"), piece(21, 12))
    return F.when(F.length(F.trim(seed)) > 0, made)


def content_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def embedding_hash(vector: Column, digits: int = 4) -> Column:
    """Fingerprint of a vector rounded to some digits."""
    return F.sha2(F.array_join(F.transform(vector, lambda x: F.format_number(x.cast("double"), digits)), "|"), 256)


def cache_key(prefix: str, schema_hash: str, *parts: Column) -> Column:
    """A readable key of the parts in order; a long one is hashed."""
    key = F.concat_ws(":", F.lit(prefix), F.lit(schema_hash), *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.when(F.length(key) > 200, F.concat_ws(":", F.lit(prefix), F.lit(schema_hash), F.sha2(key, 256))).otherwise(key)


def source_hash(function: Callable, *dependencies: Callable) -> str:
    """The first 16 digits of the hash of a function's source and of what it depends on: changes when one of them does."""
    written = "\n".join(inspect.getsource(f) for f in (function, *dependencies))
    return hashlib.sha256(written.encode()).hexdigest()[:16]
