"""Variant spellings of names typed by people, linked by merge-and-rematch resolution.

Every written name is split into forms (full name, single name, initial, pet name, epithet, kanji) whose words are
reduced to one spelling per sound.  Settled words, which groups repeat, teach the rest: an unsettled word within one edit
(two, if long) of a settled one several times as frequent is read as that word, one used in the same group first.

Full names then are blocking keys: profiles of a group that share one merge, and so do those one edit apart, unless both
are made of well-known words.  A merged profile owns the spellings,
initials, pet names and epithets of all its members and enters blocking again: weak forms (initials, single names,
pet names, epithets) of profiles without a full name merge with the one profile of the group they fit, if they fit just
one; profiles sharing an epithet or pet name and one name merge too.  This repeats until nothing merges any more.

Keys are aggregated before joining, so a group or a key may hold any share of all rows; no pairs are made but the ones
that are the result.

Cases: null group keys link nothing; null or empty arrays and names without letters give no form; a profile without a
form stays alone; repeated profiles link with each other; in words of over 64 letters slips are not looked for, the
words themselves link as any.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.names import deletions, edit_distance, initial_class, name_forms
from catalith.llm.components import components
from catalith.runtime import cut, require

SETTLED_USES, SETTLED_REPEATS = 5, 2.2  # uses, and uses a group, from which a word stands as it is and can teach others
TEACHES = 3  # times as frequent as the word read as it
LONG = 8  # letters from which two edits are allowed
EPITHET_SHARE = 0.04  # of the uses of a word after "the", from which it is no name


def written_forms(profiles: DataFrame, id_col: str, group_col: str, text_cols: tuple[str, ...], array_cols: tuple[str, ...]) -> DataFrame:
    """(g, id, n, kind, tokens): the forms of all names of a profile; n numbers them."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g, i, names in b.itertuples(index=False):
                seen = dict.fromkeys(f for t in names if t for f in name_forms(t))
                rows += [(g, i, n, f.kind, list(f.tokens)) for n, f in enumerate(seen) if f.tokens]
            yield pd.DataFrame(rows, columns=["g", "id", "n", "kind", "tokens"])

    names = F.flatten(F.array(F.array(*text_cols), *[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in array_cols]))
    kept = profiles.select(F.col(group_col).cast("string").alias("g"), F.col(id_col).cast("bigint").alias("id"), names.alias("names")).filter("g is not null and id is not null")
    return kept.mapInPandas(split, "g string, id bigint, n int, kind string, tokens array<string>")


def _edits(word: str) -> int:
    return 2 if len(word) >= LONG else 1


def settled() -> Column:
    """Whether a word is a spelling people agree on: a group that has it repeats it, while a slip comes once here, once there."""
    return (F.col("uses") >= SETTLED_USES) & (F.col("uses") >= SETTLED_REPEATS * F.col("groups"))


def read_as(words: DataFrame) -> DataFrame:
    """(word, as, distance, taught): settled words an unsettled one may stand for.  ``words``: (word, uses, groups)."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 2_000):
                rows = [(w, n, s, d) for w, n, s in b.iloc[k : k + 2_000].itertuples(index=False) if len(w) > 2 for d in deletions(w, _edits(w))]
                yield pd.DataFrame(rows, columns=["word", "uses", "settled", "rest"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = [edit_distance(w, a) for w, a in zip(b["word"], b["as"])]
            yield b.assign(distance=d)[[x <= min(_edits(w), _edits(a)) for x, w, a in zip(d, b["word"], b["as"])]]

    rests = cut(words.select("word", "uses", settled().alias("settled")).mapInPandas(spread, "word string, uses bigint, settled boolean, rest string"))
    teachers = rests.filter("settled").select(F.col("word").alias("as"), F.col("uses").alias("taught"), "rest")
    pairs = rests.filter("not settled").join(teachers, "rest").filter(F.col("taught") >= TEACHES * F.col("uses")).select("word", "as", "taught").distinct()
    return pairs.mapInPandas(measure, "word string, as string, taught bigint, distance int")


def corrected_forms(forms: DataFrame) -> DataFrame:
    """The forms with every word read as the frequent word it stands for, and epithets told from names."""
    spelled = forms.filter("kind <> 'kanji' and kind <> 'pet'")
    words = spelled.select("g", "id", "n", "kind", F.posexplode("tokens").alias("at", "word")).filter(~((F.col("kind") == "initial") & (F.col("at") == 0)))
    uses = cut(words.groupBy("word").agg(F.count("*").alias("uses"), F.count_distinct("g").alias("groups"), F.sum((F.col("kind") == "epithet").cast("int")).alias("after_the")))
    local = words.groupBy("g", "word").agg(F.count("*").alias("here"))
    offers = local.join(read_as(uses), "word").join(local.select("g", F.col("word").alias("as"), F.col("here").alias("as_here")), ["g", "as"], "left")
    chosen = offers.groupBy("g", "word").agg(F.max_by("as", F.struct(F.coalesce("as_here", F.lit(0)) > 0, -F.col("distance"), F.coalesce("as_here", F.lit(0)), "taught", "as")).alias("as"))
    epithets = uses.filter((F.col("after_the") >= 2) & (F.col("after_the") >= EPITHET_SHARE * F.col("uses"))).select(F.col("word").alias("as"), F.lit(True).alias("epithet"))
    read = words.join(chosen, ["g", "word"], "left").withColumn("as", F.coalesce("as", "word")).join(epithets, "as", "left")
    again = read.groupBy("g", "id", "n", "kind").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "as"))), lambda x: x["as"]).alias("tokens"), F.coalesce(F.bool_or("epithet"), F.lit(False)).alias("epithet")
    )
    starts = spelled.filter("kind = 'initial'").select("g", "id", "n", F.col("tokens")[0].alias("start"))
    named = again.join(starts, ["g", "id", "n"], "left").select(
        "g", "id", "n", F.when(F.col("epithet") & (F.col("kind") == "name"), "epithet").otherwise(F.col("kind")).alias("kind"), "tokens", "start"
    )
    return named.unionByName(forms.filter("kind = 'kanji' or kind = 'pet'").withColumn("start", F.lit(None).cast("string")))


def misspelt_links(forms: DataFrame) -> DataFrame:
    """(g, id, key) links of full names one edit apart, of which one at most is made of known words only.

    Names left without one letter meet on the rest; a rest that belongs to several well-known names links nobody.
    """
    full = forms.filter("kind = 'name' and size(tokens) = 2")
    words = full.select("g", F.explode("tokens").alias("word"))
    known = words.groupBy("word").agg(F.count("*").alias("uses"), F.count_distinct("g").alias("groups")).filter(settled())
    each = full.select("g", "id", F.array_join(F.array_sort("tokens"), "").alias("name"), F.explode("tokens").alias("word"))
    names = each.join(known.select("word", F.lit(True).alias("known")), "word", "left").groupBy("g", "id", "name").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("clean"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(g, i, name, clean, d) for g, i, name, clean in b.itertuples(index=False) if len(name) >= LONG for d in deletions(name, 1)]
            yield pd.DataFrame(rows, columns=["g", "id", "name", "clean", "rest"])

    rests = cut(names.mapInPandas(spread, "g string, id bigint, name string, clean boolean, rest string"))
    clean = F.when(F.col("clean"), F.col("name"))
    met = rests.groupBy("g", "rest").agg(F.min(clean).alias("one"), F.max(clean).alias("other"), F.count_distinct("id").alias("n")).filter("n > 1 and one <=> other")
    return rests.join(met, ["g", "rest"]).select("g", "id", F.concat_ws("\t", "g", F.coalesce("one", F.concat(F.lit("r:"), "rest"))).alias("key")).distinct()


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of each form: role ``full`` merges at once, ``fits`` is what a full name would fit, ``weak`` looks for it."""
    for b in batches:
        rows = []
        for g, i, kind, tokens, start in b[["g", "id", "kind", "tokens", "start"]].itertuples(index=False):
            t = list(tokens)
            if kind == "kanji":
                rows.append((g, i, "full" if len(t[0]) > 2 else "weak", "k:" + t[0]))
            elif kind == "epithet":
                rows.append((g, i, "mark", "e:" + " ".join(sorted(t))))
            elif kind == "pet":
                rows.append((g, i, "mark", "p:" + t[0]))
            elif kind == "initial":
                rows.append((g, i, "weak", f"i:{start}|{t[-1] if len(t) == 1 else ' '.join(sorted(t))}"))
            elif len(t) == 1:
                rows += [(g, i, "weak", "w:" + t[0])] + [(g, i, "full", "c:" + t[0])] * (len(t[0]) >= 10)
            else:
                rows += [(g, i, "full", "c:" + t[0] + t[-1]), (g, i, "full", "c:" + t[-1] + t[0]), (g, i, "named", "")]
                for a, o in ((t[0], t[-1]), (t[-1], t[0])):
                    rows += [(g, i, "fits", "w:" + a), (g, i, "fits", f"i:{initial_class(a)}|{o}")]
                    rows += [(g, i, "fits", "p:" + a[:n]) for n in range(2, min(7, len(a)))]
        yield pd.DataFrame(rows, columns=["g", "id", "role", "key"])


def link_variants(
    profiles: DataFrame,
    id_col: str = "profile_id",
    group_col: str = "anime_key",
    text_cols: tuple[str, ...] = ("name",),
    array_cols: tuple[str, ...] = ("name_variations", "nicknames", "alternative"),
) -> DataFrame:
    """(id, label, g): one row per profile that has a form; profiles of one label mean the same."""
    require(profiles, id_col, group_col, *text_cols, *array_cols)
    forms = cut(written_forms(profiles, id_col, group_col, text_cols, array_cols))
    corrected = cut(corrected_forms(forms))
    keys = cut(corrected.mapInPandas(_keys, "g string, id bigint, role string, key string").distinct())
    ids = cut(keys.select("id", "g").distinct())
    full = keys.filter("role = 'full'").select("g", "id", F.concat_ws("\t", "g", "key").alias("key"))
    labels = components(ids.select("id"), full.unionByName(misspelt_links(corrected)))
    merged = -1
    while True:  # merged profiles own what their members own, and look again
        owned = cut(
            keys.join(labels, "id").groupBy("g", "label").agg(F.collect_set(F.struct("role", "key")).alias("all"), F.bool_or(F.col("role") == "named").alias("named"))
        )
        now = owned.count()
        if now == merged:
            return labels.join(ids, "id")
        merged = now
        higher = components(owned.select(F.col("label").alias("id")), _rematches(owned))
        labels = cut(labels.join(higher.select(F.col("id").alias("label"), F.col("label").alias("top")), "label").select("id", F.col("top").alias("label")))


def _rematches(owned: DataFrame) -> DataFrame:
    """(g, id, key) links between merged profiles."""
    each = owned.select("g", "label", "named", F.explode("all").alias("f")).select("g", "label", "named", "f.role", "f.key")
    fits = each.filter("named and role in ('fits', 'weak', 'mark')").groupBy("g", "key").agg(F.min("label").alias("one"), F.max("label").alias("other"))
    seen = each.filter("not named and role in ('weak', 'mark')").join(fits, ["g", "key"], "left")
    votes = F.collect_list(F.when(F.col("one") == F.col("other"), F.col("one")))
    judged = seen.groupBy("g", "label").agg(votes.alias("votes"), F.collect_set(F.when(F.col("one").isNull(), F.col("key"))).alias("free"))
    chosen = F.try_element_at(F.filter(F.array_distinct("votes"), lambda v: 2 * F.size(F.filter("votes", lambda w: w == v)) > F.size("votes")), F.lit(1))
    judged = judged.withColumn("one", chosen)
    hit = F.when(F.col("one").isNotNull(), F.array(*[F.struct(x.alias("id"), F.concat(F.lit("l:"), F.col("one")).alias("key")) for x in (F.col("label"), F.col("one"))]))
    free = F.transform("free", lambda k: F.struct(F.col("label").alias("id"), F.concat_ws("\t", "g", k).alias("key")))
    nameless = judged.select("g", F.explode(F.concat(F.coalesce(hit, F.array().cast("array<struct<id:bigint,key:string>>")), free)).alias("l"))
    pick = lambda *tests: F.transform(F.filter("all", lambda f: _any(f, tests)), lambda f: f["key"])
    marks, words, alone, full = pick(("mark", "")), pick(("fits", "w:")), pick(("weak", "w:")), pick(("full", "c:"))
    marked = F.flatten(F.transform(marks, lambda m: F.transform(words, lambda w: F.concat_ws("\t", m, w))))
    part = lambda k: F.substr(k, F.lit(3))
    wider = F.flatten(F.transform(alone, lambda x: F.transform(F.filter(words, lambda w: w != x), lambda w: F.concat(F.lit("c:"), F.least(part(x), part(w)), F.greatest(part(x), part(w))))))
    richer = owned.filter("named").select("g", "label", F.explode(F.array_distinct(F.concat(marked, wider, full))).alias("key"))
    return nameless.select("g", "l.id", "l.key").unionByName(richer.select("g", F.col("label").alias("id"), F.concat_ws("\t", "g", "key").alias("key")))


def _any(f: Column, tests: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda x, y: x | y, [(f["role"] == role) & f["key"].startswith(start) for role, start in tests])


def variant_pairs(labels: DataFrame) -> DataFrame:
    """(a, b): all pairs of one label, a < b, as the result is defined."""
    other = labels.select(F.col("id").alias("b"), "label")
    return labels.select(F.col("id").alias("a"), "label").join(other, "label").filter("a < b").select("a", "b")
