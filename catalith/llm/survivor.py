"""One surviving value per field of each group of records that describe one thing, by Bayesian fusion.

Every record's field is a claim of its source for a value, and what speaks for a claim is its *evidence class*: how far
it stays behind the best of its group by the field's own measure (completeness of a synopsis, episodes with titles of
their own, recency and trust of a status).  Claims are pre-aggregated to one row per group, field and value with the
set of its sources and their classes, so a group of any size costs no more than its distinct values.  Then, a few times:

* the accuracy of a (field, source, class) is the mean posterior of the values claimed so, drawn towards that of its
  class where claims are few; before the first round the classes have the accuracies ``FIRST_ACCURACY``;
* two sources depend on each other in a field as far as they share values that are false (no longer believed) more
  often than independent sources would; a copied vote is discounted by the probability that it was copied;
* the posterior of a value is that of its discounted votes, each the log-odds of its claim's accuracy.

So the measure is no rule that decides: a source that always comes last with values nobody else has loses its accuracy
and is outvoted, unless those against it are copies of one another.  Only figures per source and class and per pair of
sources (a small dimension) come to the driver.

What says nothing or is damaged is no claim and never survives: blanks and placeholders, texts cut off, with broken
characters, left-over markup or page furniture, or blown up by repetition.  Furniture is learnt from all records: a
sentence that stands under at least ``FURNITURE_SHARE`` of the groups (and five) belongs to no synopsis.

Cases: records with a null group key are left out; groups of one record give no row; a field nobody states soundly
gives no row; at equal posteriors the smaller record id survives; repeated records change nothing; an impossible or
null time counts as oldest; records of no source count as of one source; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.runtime import cut, require

# Wordings that stand in for a missing value, in the languages of the feeds; fixed values.
NOTHING = [
    "", "-", "--", "?", "??", ".", "...", "…", "n/a", "na", "none", "null", "nil", "unknown", "undefined", "tba", "tbd", "not available", "unbekannt", "inconnu", "sconosciuto", "desconocido", "untitled",
    "no synopsis has been added for this series yet.", "keine beschreibung vorhanden.", "synopsis coming soon!", "no description available.",
]
# Status spellings by meaning; fixed values.
STATUSES = {
    "FINISHED": ["finished", "finished airing", "completed", "complete", "ended", "aired", "abgeschlossen", "terminé", "concluso", "finalizado"],
    "ONGOING": ["ongoing", "current", "currently airing", "airing", "releasing", "läuft", "en cours", "in corso", "en emisión"],
    "UPCOMING": ["upcoming", "not yet aired", "not_yet_released", "announced", "planned", "geplant", "à venir", "annunciato", "próximamente"],
    "HIATUS": ["hiatus", "on hiatus", "pausiert"],
    "CANCELLED": ["cancelled", "canceled", "discontinued", "abgebrochen"],
}
PLACEHOLDER_TITLE = r"^(?:(?:episode|ep|folge|épisode|episodio|chapter)?[\s.:#]*\d+|第?\s*\d+\s*話)$"
CUT_OFF = r"(?i)(?:\.\.\.|…|\[(?:more|weiterlesen)\]|\((?:read )?more\)|read more|[-–,;:])$|[^.!?。！？…\"'”’»)\]]$"
BROKEN = r"�|Ã[\x{80}-\x{BF}]|â€|Â[\x{A0}-\x{BF}]"
MARKUP = r"<[a-zA-Z/][^>]*>|&(?:[a-zA-Z]{2,8}|#\d+);"
FURNITURE_SHARE = 0.005
ROUNDS = 3
CLASSES = 8  # at most; class 0 is the best of its group, 1 its equal but for the second measure
FIRST_ACCURACY = (0.9, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.1)
FEW = 20.0  # claims as which the accuracy of a class counts beside those of a source
LEAST, MOST = 0.02, 0.98  # accuracies
COPY_RATE, PRIOR_DEPENDENCE = 0.8, 0.1
FALSE_VALUES = {"synopsis": 10, "episodes": 10, "status": 4}  # that a field can take, about
FIELDS = ("synopsis", "episodes", "status")


def says_nothing(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " "))).isin(NOTHING)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?。！？])\s*(?=\S)(?<![.]{2})"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def furniture(records: DataFrame, group_col: str, text_col: str) -> DataFrame:
    """Sentences that stand under so many groups that they belong to none; at most 200 times the mean sentences a group."""
    groups = records.agg(F.count_distinct(group_col).alias("n"))
    return (
        records.select(F.col(group_col).alias("g"), F.explode(F.array_distinct(sentences(F.col(text_col)))).alias("sentence"))
        .distinct()
        .groupBy("sentence")
        .agg(F.count("*").alias("seen"))
        .crossJoin(groups)  # one row
        .filter(F.col("seen") >= F.greatest(F.lit(5), F.ceil(F.col("n") * FURNITURE_SHARE)))
        .select("sentence")
    )


def _synopses(base: DataFrame) -> DataFrame:
    """Soundness, rank and value of each synopsis."""
    spread = base.select("record_id", F.explode(F.array_distinct(sentences(F.col("synopsis")))).alias("sentence"))
    tainted = spread.join(furniture(base, "g", "synopsis"), "sentence", "left_semi").select("record_id").distinct().withColumn("tainted", F.lit(True))
    text, said = F.col("synopsis"), sentences(F.col("synopsis"))
    whole = F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " "))
    sound = ~says_nothing(text) & ~text.rlike(MARKUP) & ~text.rlike(BROKEN) & ~whole.rlike(CUT_OFF) & (F.size(said) == F.size(F.array_distinct(said)))
    return (
        base.join(tainted, "record_id", "left")
        .select("record_id", "g", "source", F.lit("synopsis").alias("field"), F.xxhash64(F.lower(whole)).alias("value"), says_nothing(text).alias("empty"),
                F.when(sound & F.col("tainted").isNull(), F.array(F.length(whole).cast("double"), F.lit(0.0))).alias("rank"))
    )


def _episode_lists(base: DataFrame) -> DataFrame:
    titles = F.transform("episodes", lambda e: F.lower(F.trim(e["title"])))
    own = F.array_sort(F.array_distinct(F.filter(titles, lambda t: t.isNotNull() & ~t.isin(NOTHING) & ~t.rlike(PLACEHOLDER_TITLE))))
    n = F.coalesce(F.size(own), F.lit(0))
    spare = -(F.size("episodes") - n).cast("double")  # of equal ones that with less besides
    return base.select("record_id", "g", "source", F.lit("episodes").alias("field"), F.xxhash64(own).alias("value"), (F.coalesce(F.size("episodes"), F.lit(0)) < 1).alias("empty"), F.when(n > 0, F.array(n.cast("double"), spare)).alias("rank"))


def _statuses(base: DataFrame, earliest: str, latest: Column) -> DataFrame:
    plain = F.lower(F.trim("status"))
    meaning = F.coalesce(*[F.when(plain.isin(spellings), name) for name, spellings in STATUSES.items()], F.upper(plain))
    at = F.col("at").cast("timestamp")
    seconds = F.coalesce(F.when((at >= F.lit(earliest).cast("timestamp")) & (at <= latest), F.unix_micros(at) / 1e6), F.lit(0.0))
    return base.select("record_id", "g", "source", F.lit("status").alias("field"), F.xxhash64(meaning).alias("value"), says_nothing(F.col("status")).alias("empty"), F.when(~says_nothing(F.col("status")), F.array(seconds, F.coalesce("trust", F.lit(0)).cast("double"))).alias("rank"))


def _classes() -> Column:
    """The evidence class of a claim by its rank and the best rank of its group; status by days behind, others by share."""
    first, best = F.col("rank")[0], F.col("top")[0]
    days, share = (best - first) / 86_400, first / best
    late = F.when(first <= 0, 6).when(days <= 1, 2).when(days <= 30, 3).when(days <= 365, 4).otherwise(5)
    less = F.when(share >= 0.95, 2).when(share >= 0.8, 3).when(share >= 0.5, 4).otherwise(5)
    return F.when(F.col("rank") == F.col("top"), 0).when(first == best, 1).when(F.col("field") == "status", late).otherwise(less)


class Beliefs:
    """What is known of sources: accuracies by (field, source, class), and pairs of sources that depend, by field."""

    def __init__(self, sources: int):
        self.sources = sources
        self.accuracy: dict[tuple[str, int], float] = {}
        self.copied: dict[tuple[str, int, int], float] = {}

    def of(self, field: str, cell: int) -> float:
        return min(max(self.accuracy.get((field, cell), FIRST_ACCURACY[cell % CLASSES]), LEAST), MOST)

    def votes(self) -> Column:
        """Log-odds of a value from its claims, the likeliest first, each discounted by the chance that one before was copied."""
        cells, n = self.sources * CLASSES, self.sources
        at = {f: k for k, f in enumerate(FIELDS)}
        accuracy = {(f, c): self.of(f, c) for f in FIELDS for c in range(cells)}
        vote = F.lit([math.log(FALSE_VALUES[f] * a / (1 - a)) for (f, _), a in accuracy.items()])
        place = F.lit([k for f in FIELDS for k in self._places({c: accuracy[f, c] for c in range(cells)})])
        keep = [1.0] * (len(FIELDS) * n * n)
        for (f, s, t), p in self.copied.items():
            for x, y in ((s, t), (t, s)):
                keep[(at[f] * n + x) * n + y] = 1 - COPY_RATE * p
        kept = F.lit(keep)
        field = F.coalesce(*[F.when(F.col("field") == f, k) for f, k in at.items()])
        source = lambda c: F.floor(c / CLASSES).cast("int")
        by_place = F.array_sort(F.transform("claims", lambda c: F.struct(F.get(place, field * cells + c).alias("place"), c.alias("cell"))))

        def add(so_far: Column, claim: Column) -> Column:
            s = source(claim["cell"])
            weight = F.aggregate(so_far["before"], F.lit(1.0), lambda w, t: w * F.get(kept, (field * n + s) * n + t))
            return F.struct((so_far["total"] + weight * F.get(vote, field * cells + claim["cell"])).alias("total"), F.array_append(so_far["before"], s).alias("before"))

        start = F.struct(F.lit(0.0).alias("total"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(by_place, start, add, lambda x: x["total"])

    @staticmethod
    def _places(accuracy: dict[int, float]) -> list[int]:
        order = sorted(accuracy, key=lambda c: (-accuracy[c], c))
        return [place for _, place in sorted(zip(order, range(len(order))))]

    def learn(self, believed: DataFrame, copies: bool = True) -> None:
        """New accuracies and dependences from the posteriors of all values; a row per cell and per pair of sources comes here."""
        each = believed.groupBy("field", "claims", "true").agg(F.count("*").alias("n"), F.sum("posterior").alias("p"))
        pairs = each.select("field", "true", "n", "p", "claims", F.explode("claims").alias("c")).select("field", "true", "n", "p", "c", F.explode("claims").alias("d")).filter("c <= d")
        cell = F.when(F.col("c") == F.col("d"), F.col("c"))
        sums = pairs.groupBy("field", cell.alias("cell"), F.floor(F.col("c") / CLASSES).alias("s"), F.floor(F.col("d") / CLASSES).alias("t")).agg(
            F.sum(F.when(F.col("true"), F.col("n")).otherwise(0)).alias("right"), F.sum(F.when(~F.col("true"), F.col("n")).otherwise(0)).alias("wrong"), F.sum("p").alias("p")
        )
        rows = sums.collect()
        alone = [r for r in rows if r["cell"] is not None]
        self.accuracy, by_class, by_source = {}, defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])
        for r in alone:
            n = r["right"] + r["wrong"]
            for total in (by_class[r["field"], r["cell"] % CLASSES], by_source[r["field"], r["s"]]):
                total[0] += r["p"]
                total[1] += n
        for r in alone:
            p, n = by_class[r["field"], r["cell"] % CLASSES]
            self.accuracy[r["field"], r["cell"]] = (r["p"] + FEW * p / n) / (r["right"] + r["wrong"] + FEW)
        self.copied = {}
        for r in rows if copies else ():
            if r["cell"] is None:
                a, b = (min(max(p / n, 0.05), 0.95) for p, n in (by_source[r["field"], r["s"]], by_source[r["field"], r["t"]]))
                self.copied[r["field"], r["s"], r["t"]] = dependence(a, b, r["right"], r["wrong"], FALSE_VALUES[r["field"]])


def dependence(a: float, b: float, shared_true: int, shared_false: int, false_values: int) -> float:
    """Probability that one of two sources of these accuracies copies the other, from the values they share."""
    right, wrong = a * b, (1 - a) * (1 - b) / false_values
    copied_right, copied_wrong = a * COPY_RATE + right * (1 - COPY_RATE), (1 - a) * COPY_RATE + wrong * (1 - COPY_RATE)
    total, copied = right + wrong, copied_right + copied_wrong
    odds = math.log(PRIOR_DEPENDENCE / (1 - PRIOR_DEPENDENCE))
    odds += shared_true * math.log(copied_right / copied / (right / total)) + shared_false * math.log(copied_wrong / copied / (wrong / total))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def fuse(records: DataFrame, sources: DataFrame, earliest: str = "2000-01-01", latest: Column | None = None, votes: bool = True, copies: bool = True) -> DataFrame:
    """(anime_key, field_name, record_id, posterior): the record whose value survives, per field and group of two or more.

    Without ``votes`` all claims weigh nothing, without ``copies`` sources count as independent: to see what each does.
    """
    require(records, "record_id", "anime_key", "feed_id", "synopsis", "episodes", "status", "updated_at")
    trust = sources.select("feed_id", "trust").dropDuplicates(["feed_id"])
    base = (
        records.filter(F.col("anime_key").isNotNull())
        .select("record_id", F.col("anime_key").alias("g"), F.col("feed_id"), "synopsis", "episodes", "status", F.col("updated_at").alias("at"))
        .join(trust, "feed_id", "left")
        .withColumnRenamed("feed_id", "source")
    )
    several = base.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")
    claims = _synopses(base).unionByName(_episode_lists(base)).unionByName(_statuses(base, earliest, latest if latest is not None else F.current_timestamp()))
    claims = cut(claims.filter(~F.col("empty") & F.col("rank").isNotNull()).join(several, "g", "left_semi"))
    names = [r[0] for r in claims.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s")).distinct().orderBy("s").collect()]  # the sources: a small dimension
    names = names or [""]
    item = ["g", "field"]
    topped = claims.join(claims.groupBy(*item).agg(F.max("rank").alias("top")), item)  # aggregated before the join: a hot group is one row there
    cell = (F.array_position(F.lit(names), F.coalesce(F.col("source").cast("string"), F.lit(""))).cast("int") - 1) * CLASSES + _classes()
    better = lambda c, others: F.exists(others, lambda d: (F.floor(d / CLASSES) == F.floor(c / CLASSES)) & (d < c))
    values = cut(
        topped.groupBy(*item, "value")
        .agg(F.sort_array(F.collect_set(cell)).alias("cells"), F.max_by("record_id", F.struct("rank", -F.col("record_id"))).alias("record_id"))
        .select(*item, "record_id", F.filter("cells", lambda c: ~better(c, F.col("cells"))).alias("claims"))  # of a source its best claim for the value
    )
    beliefs = Beliefs(len(names))
    for turn in range(ROUNDS):
        scored = values.withColumn("score", F.round(beliefs.votes(), 9) if votes else F.lit(0.0)).withColumn("weight", F.exp(F.least(F.greatest("score", F.lit(-600.0)), F.lit(600.0))))
        believed = scored.join(scored.groupBy(*item).agg(F.sum("weight").alias("total")), item)
        believed = believed.withColumn("posterior", F.col("weight") / F.col("total")).withColumn("true", F.col("posterior") > 0.5)
        if turn < ROUNDS - 1 and votes:
            beliefs.learn(believed, copies)
    survivor = F.max_by(F.struct("record_id", "posterior"), F.struct("score", -F.col("record_id")))
    return believed.groupBy(*item).agg(survivor.alias("s")).select(F.col("g").alias("anime_key"), F.col("field").alias("field_name"), "s.record_id", "s.posterior")
