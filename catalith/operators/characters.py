"""One character in several sources: ensemble name scores, best matches, pools that shrink, integrated records.

Candidates of a title meet by equality of the title and, within it, in blocks of a shared name word or native sign, so
the work grows with the matches and not with the square of a cast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.functions.arrays import distinct_ignoring_case, nickname_distinct, ordered_distinct
from catalith.functions.names import HONORIFICS, sound_key
from catalith.functions.text import edit_ratio, token_set_ratio_of
from catalith.operators.joins import best_match

# Weights of the signals by source; fixed values.
WEIGHTS = {
    "anilist": {"semantic": 0.45, "visual": 0.30, "edit_distance": 0.05, "token_based": 0.15, "token_set": 0.03, "phonetic": 0.02, "name_order": 0.0},
    "anidb": {"semantic": 0.65, "visual": 0.25, "edit_distance": 0.02, "token_based": 0.08, "token_set": 0.0, "phonetic": 0.0, "name_order": 0.0},
    "animeplanet": {"semantic": 0.50, "visual": 0.30, "edit_distance": 0.05, "token_based": 0.10, "token_set": 0.05, "phonetic": 0.0, "name_order": 0.0},
    "generic": {"semantic": 0.50, "visual": 0.25, "edit_distance": 0.05, "token_based": 0.12, "token_set": 0.05, "phonetic": 0.03, "name_order": 0.0},
}
SOURCES = ("anilist", "anidb", "animeplanet")
AT_ONCE, ACCEPT = 0.9, 0.7


def _orders(name: str) -> list[str]:
    """The name in both orders, and without a middle initial."""
    words = [w for w in name.replace(",", " ").split() if w]
    short = [w for w in words if len(w.rstrip(".")) > 1]
    return list(dict.fromkeys(" ".join(w) for w in (words, words[::-1], short, short[::-1]) if w))


def name_similarity(a: str, b: str) -> float:
    """A stand-in for a text encoder: the best edit ratio of sound keys over all orders and native halves."""
    left, right = ([sound_key(o.replace(" ", "")) or o for part in x.split("|") for o in _orders(part.strip())] for x in (a, b))
    return max((edit_ratio(x, y) for x in left for y in right if x and y), default=0.0)


def signals(a: str, b: str) -> dict[str, float]:
    x, y = a.strip().lower(), b.strip().lower()
    words = lambda s: [w for w in s.replace(",", " ").replace("-", " ").split() if w]
    p, q = words(x), words(y)
    key = lambda ws: " ".join(sound_key(w) for w in ws)
    return {
        "semantic": name_similarity(a, b), "visual": 0.0, "edit_distance": edit_ratio(x, y), "token_based": edit_ratio(" ".join(sorted(p)), " ".join(sorted(q))), "token_set": token_set_ratio_of(" ".join(p), " ".join(q)),
        "phonetic": 1.0 if key(p) == key(q) else edit_ratio(key(p), key(q)), "name_order": max(edit_ratio(" ".join(p), " ".join(q)), edit_ratio(" ".join(p), " ".join(q[::-1]))),
    }


def ensemble(a: str | None, aliases: list[str], source: str, visual: float = 0.0) -> float:
    """The best weighted sum of signals over a candidate's names."""
    weights = WEIGHTS.get(source, WEIGHTS["generic"])
    best = 0.0
    for b in aliases:
        if a and b:
            s = signals(a, b) | {"visual": visual}
            best = max(best, sum(s[k] * w for k, w in weights.items()))
    return best


def ensemble_udf(source: str):  # noqa: ANN201
    @F.pandas_udf(T.DoubleType())
    def score(names: pd.Series, aliases: pd.Series, visual: pd.Series) -> pd.Series:
        return pd.Series([ensemble(n, [x for x in (a if a is not None else [])], source, v if v == v and v is not None else 0.0) for n, a, v in zip(names, aliases, visual)], dtype="float64")

    return score


@F.pandas_udf(T.ArrayType(T.StringType()))
def block_keys(names: pd.Series) -> pd.Series:
    """Sound keys of the words of a row's names, and single native signs."""

    def keys(values: list | None) -> list[str]:
        out: dict[str, None] = {}
        for n in values if values is not None else []:
            for w in (n or "").replace("|", " ").replace(",", " ").split():
                k = sound_key(w)
                out.update(dict.fromkeys([k] if len(k) > 1 else [c for c in w if ord(c) > 0x2E80]))
        return list(out)

    return names.map(keys)


def match_source(primary: DataFrame, candidates: DataFrame, source: str, visual: Column | None = None) -> DataFrame:
    """(pid, cid, score) of the best candidate of each primary; both (title_key, pid or cid, names array<string>)."""
    a = primary.select("title_key", "pid", F.col("names").alias("a_names"), F.explode(block_keys("names")).alias("k"))
    b = candidates.select("title_key", "cid", F.col("names").alias("b_names"), F.explode(block_keys("names")).alias("k"))
    met = a.join(b, ["title_key", "k"]).drop("k").dropDuplicates(["pid", "cid"])
    scored = met.select("pid", "cid", ensemble_udf(source)(F.try_element_at("a_names", F.lit(1)), F.col("b_names"), visual if visual is not None else F.lit(0.0)).alias("score"))
    return best_match(scored, "pid", "cid", "cid", AT_ONCE, ACCEPT)


def match_all(primary: DataFrame, pools: dict[str, DataFrame]) -> DataFrame:
    """(pid, <source>_id, <source>_score ...) against every pool independently."""
    out = primary.select("pid")
    for source, pool in pools.items():
        found = match_source(primary, pool, source).select("pid", F.col("cid").alias(f"{source}_id"), F.col("score").alias(f"{source}_score"))
        out = out.join(found, "pid", "left")
    return out


@dataclass
class Pools:
    """Candidates left of each source, in order."""

    left: dict[str, dict[int, list[str]]] = field(default_factory=dict)

    def best(self, source: str, name: str) -> int | None:
        top, score = None, 0.0
        for cid, names in self.left[source].items():
            s = round(ensemble(name, names, source), 9)
            if s >= AT_ONCE:
                return cid
            if s > score:
                top, score = cid, s
        return top if score >= ACCEPT else None


def progressive(members: DataFrame) -> DataFrame:
    """(title_key, pid, found_in, ids) of primaries taken in order against pools that shrink.

    ``members``: (title_key, role: primary or a source, id, pos, names).  A primary found in every source takes its
    partners out of the pools; one found in some leaves them.  The order matters, so a title is one group; its size is
    that of a cast.
    """

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        pools = Pools({s: {int(r.id): list(r.names) for r in g[g.role == s].itertuples()} for s in SOURCES})
        rows = []
        for r in g[g.role == "primary"].itertuples():
            found = {s: pools.best(s, next(iter(r.names), "") or "") for s in SOURCES}
            if all(v is not None for v in found.values()):
                for s, v in found.items():
                    del pools.left[s][v]
            hit = [s for s in SOURCES if found[s] is not None]
            rows.append((key[0], int(r.id), hit, [found[s] for s in hit]))
        return pd.DataFrame(rows, columns=["title_key", "pid", "found_in", "ids"])

    return members.groupBy("title_key").applyInPandas(run, f"title_key {members.schema['title_key'].dataType.simpleString()}, pid bigint, found_in array<string>, ids array<bigint>")


def integrate(mal: DataFrame, matches: DataFrame, anilist: DataFrame, planet: DataFrame) -> DataFrame:
    """Matched records as one: names and nicknames of all, favourites of both, fields by the order of the sources."""
    text = lambda *cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])
    a, p = anilist.select(*[F.col(c).alias(f"a_{c}") for c in anilist.columns]), planet.select(*[F.col(c).alias(f"p_{c}") for c in planet.columns])
    joined = mal.join(matches, "pid", "left").join(a, F.col("anilist_id") == F.col("a_id"), "left").join(p, F.col("animeplanet_id") == F.col("p_id"), "left")
    return joined.select(
        "pid", text(F.col("name")).alias("name"), text(F.col("name_native"), F.col("a_name_native")).alias("name_native"), distinct_ignoring_case(F.array("name", "name_native", "a_name", "a_name_native", "p_name"), F.col("a_alternative")).alias("name_variations"),
        nickname_distinct(F.coalesce("nicknames", F.array().cast("array<string>"))).alias("nicknames"), text(F.col("a_age"), F.col("p_age")).alias("age"), text(F.col("a_gender"), F.col("p_gender")).alias("gender"), text(F.col("about"), F.col("a_description")).alias("description"),
        (F.coalesce("favorites", F.lit(0)) + F.coalesce("a_favourites", F.lit(0))).alias("favorites"), ordered_distinct(F.array("image"), F.array("a_image"), F.array("p_image")).alias("images"),
        (F.lit(1) + F.col("a_id").isNotNull().cast("int") + F.col("p_id").isNotNull().cast("int")).alias("source_count"),
    )


def remove_taken(pool: DataFrame, taken: DataFrame, key: str = "cid") -> DataFrame:
    return pool.join(taken.select(key), key, "left_anti")


def plain_name(name: Column) -> Column:
    """Without a closing title of respect."""
    return F.regexp_replace(name, "(?i)" + HONORIFICS, "")


def id_from_page(url: Column, source: str) -> Column:
    """What stands behind ``/character/`` in an address; a number for sources that count."""
    tail = F.nullif(F.regexp_extract(url, r"/characters?/([^/?#]+)", 1), F.lit(""))
    return tail.try_cast("bigint").cast("string") if source == "anilist" else tail
