"""Personal information in free text: found, typed and replaced.

Addresses of mail, telephone and identity numbers and postal addresses have forms of their own and are recognised by
them.  Names have none, and no wording that introduces them is written down here: which wordings do is learnt from the
corpus.  A pair of words that may be a name (a mention) is described by its terms: up to three words before and after
it, a structured item beside it standing as a sign of its kind, and the two words themselves.  Then:

* a mention co-occurs with a protected entity if its document holds a structured item apart from it or one adjoins it;
* for each term the share of its mentions that co-occur is counted, each spelling of a name once, however often it or
  copies of its document appear; longer contexts draw on shorter ones where they are rare;
* the disclosure of a mention is the sum of the log-odds by which the terms before it, after it and in it exceed the
  share of all mentions; those above a threshold are protected entities themselves, and the counting is repeated
  ``ROUNDS`` times with them in place of the structured items.

A greeting and the first half of the name after it are no mention; greetings are learnt from the corpus too.  Mentions
above ``DISCLOSURE`` in the end are names.  The contexts learnt are then looked for in all texts once more, to
find names typed in small letters, which are judged by the same terms.

Found spans are replaced by typed placeholders, everything else stays as it is, letter by letter.

Cases: null texts give no row (and stay null when sanitised); empty texts and texts without personal information stay
unchanged; where kinds overlap, mail holds before postal addresses and these before numbers, of numbers the one that
begins first (then the longer one), of names that with the greater disclosure; full-width digits and signs are read
like plain ones, the surface stays as written; copies count each; texts of any length are read whole; a corpus without
structured items gives no names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.runtime import cut, require

FIRST, NEXT, DISCLOSURE = 2.0, 3.0, 4.0  # log-odds from which a mention is protected: at first, in between, in the end
ROUNDS = 3
SUPPORT = 3  # different names a term needs to count
PRIOR = 2.0  # names as which the shorter context counts beside the longer one
APART = 60  # letters from which a structured item does not share its sentence with a mention
CUE, MOST_CUES = 0.6, 100_000  # share from which a context may introduce a name in small letters; contexts sent to the executors at most
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# Letters of full width and variants of space and dash, one for one, so that offsets stay.
_PLAIN = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 32, 0xA0: 32, 0x2007: 32, 0x2009: 32, 0x202F: 32}
_PLAIN |= dict.fromkeys((0x2010, 0x2011, 0x2012, 0x2013, 0x2212), 45)

_LOCAL, _LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9])?", r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_AT, _DOT = r"(?:\s?[\[({]\s?at\s?[\])}]\s?|\sat\s(?=[\w\-]+\s?(?:[\[(]\s?dot|dot\s)))", r"(?:\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
EMAIL = re.compile(rf"(?<![\w.+%\-@])(?:{_LOCAL}\s?@\s?{_LABEL}(?:\.{_LABEL})+|{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+)(?![\w@])", re.IGNORECASE)

_EDGE, _END = r"(?<![\w\-./#+()])", r"(?![\w]|[\-./]\d)"
ID_NUMBER = re.compile(
    _EDGE
    + r"(?:"
    + r"|".join(
        [
            r"[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|[12]\d{14}",  # national registers of 15 digits
            r"\d{4} \d{4} \d{4}(?! \d{4})|\d{4}-\d{4}-\d{4}(?!-\d{4})",
            r"\d{3} \d{2} \d{4}|\d{3}-\d{2}-\d{4}",
            r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]",
            r"[A-Z]{2}\d{7}",
            r"[A-Z]\d[A-Z]\d{2}[A-Z]{2}\d{2}|[CFGHJKLMNPRTVWXYZ]\d[0-9CFGHJKLMNPRTVWXYZ]{7}",  # machine-readable cards
            r"0\d{8}",
        ]
    )
    + r")"
    + _END
)
_S = r"[ .\-/]?"
PHONE = re.compile(
    r"(?<![\w\-./#+])(?:"
    + r"|".join(
        [
            rf"(?:\+|00)\d{{1,3}}{_S}(?:\(0?\d{{1,4}}\){_S})?\d{{1,5}}(?:{_S}\d{{2,8}}){{0,5}}",
            r"\(0?\d{2,5}\) ?\d{3,8}(?:[ \-./]\d{2,6}){0,3}",
            r"0\d(?:[ .\-]\d{2}){4}",
            r"0\d{1,4}[ \-/.]\d{2,8}(?:[ \-/.]\d{2,6}){0,3}",
            r"0\d{9,10}",
            r"(?:1[ .\-])?[2-9]\d{2}[ .\-]\d{3}[ .\-]\d{4}|1[2-9]\d{9}",
            r"\d(?: \d){8,12}",
        ]
    )
    + r")"
    + _END
)

_PLACE = r"[A-ZÀ-Þ][\w'’]+(?:-[A-ZÀ-Þ][\w'’]+)*"
_POST = r"\d{5}"
_WAY = r"(?:Road|Rd\.?|Lane|Ln\.?|Close|Street|St\.?|Avenue|Ave\.?|Row|Quay|Walk|Terrace|Court|Drive|Place|Square|Way|Crescent|Hill|Gardens|Mews)"
_EN = (
    rf"(?:(?:Flat|Apt\.?|Unit) \d+[A-Za-z]?, ?)?(?:No\. ?)?\d{{1,4}}(?:-?[A-Z])?,? (?:[A-Z][\w'’]+ ){{1,3}}{_WAY}(?:, ?(?:Flat|Apt\.?|Unit) \d+[A-Za-z]?)?"
    rf"[,\s]\s?(?:near )?{_PLACE}(?:,? {_POST})?"
)
_BOX = rf"P\.? ?O\.? Box \d+,?\s{_PLACE}(?:,? {_POST})?"
_FR = rf"\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|impasse|quai|place|boulevard|allée|chemin|cours|passage)(?: [\w'’À-ÿ\-]+){{1,6}}?,\s?{_POST} {_PLACE}"
_ES = rf"(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino)(?: [\w'’À-ÿ]+){{1,5}}? \d{{1,4}}(?:, ?(?:bajo|\d{{1,2}}\.? ?[ºª°] ?[\w.]*\.?))?,\s?{_POST} {_PLACE}"
_IT = rf"(?:Via|Viale|Piazza|Corso|Vicolo|Largo|Strada)(?: [\w'’À-ÿ]+){{1,5}}?(?: n\.)?,? \d{{1,4}}(?:/?[a-z])?,\s?{_POST} {_PLACE}"
_DE = rf"[A-ZÄÖÜ][\w\-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig|markt|hof)(?: [\w\-]+)?? \d{{1,4}} ?[a-z]?,\s?{_POST} {_PLACE}"
_JA_NAME = r"[一-鿿々ヶケノ]"
_JA = rf"(?:〒 ?\d{{3}}-\d{{4}}\s?)?{_JA_NAME}{{1,5}}?[都道府県市区町村](?:{_JA_NAME}{{1,8}}?)?\d{{1,3}}(?:丁目\d{{1,3}}(?:-\d{{1,3}}){{0,2}}|(?:-\d{{1,3}}){{1,3}})"
ADDRESS = re.compile(rf"(?<![\w\-])(?:{_EN}|{_BOX}|{_FR}|{_ES}|{_IT}|{_DE})(?![\w])|{_JA}(?![\d\-])")

_CAPS = r"[A-ZÀ-Þ][^\W\d_]+(?:['’][^\W\d_]+)?"
#: two capitalised words, at every place where such a pair begins
CANDIDATE = re.compile(rf"(?<![\w@.\-])(?=(?P<name>{_CAPS}(?:, | (?:[A-Z]\. )?){_CAPS}(?:-{_CAPS})?)(?![\w@\-]))")
_SMALL = r"[^\W\d_]{3,}(?: [^\W\d_]\.)? [^\W\d_]{3,}(?:-[^\W\d_]+)?"
SMALL_AFTER, SMALL_BEFORE = re.compile(rf"({_SMALL})(?![\w@\-])"), re.compile(rf"(?<![\w@.\-])({_SMALL})$")
TOKEN = re.compile(r"\w+|[^\w\s]")
SENTENCE_END = re.compile(r"[.!?]\s|[。！？]")
MARKS = {"email": "\ue001", "phone": "\ue002", "id_number": "\ue003", "address": "\ue004"}  # stand for items in contexts

# Words with which no name begins; fixed values.
NO_NAME = set(
    # articles, prepositions and conjunctions of the six languages that are written in Latin letters
    """
    the a an my your our his her their this that to for from of in on at by with under over after before as when where while if and or all everyone
    der die das dem den des ein eine am im auf aus bei mit nach von vor zu zum zur über unter als bis denn dass seit weil wenn wo während ob und oder alle viele
    le la les un une des du de au aux dans sur sous pour par avec sans chez quand où et ou tous
    el los las una unos del al en con por para sin sobre desde hasta cuando donde y o todos
    il lo gli i uno di da nel nella su per tra fra quando dove e ed tutti
    """.split()
)



def parts(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[^\W\d_]{2,}", name)]


def plain(text: str) -> str:
    """The text with full-width signs as plain ones; of the same length."""
    return text.translate(_PLAIN)


def structured(t: str) -> list[tuple[int, int, str]]:
    """Spans of addresses and numbers in a plain text, free of overlaps."""
    found = [(m.start(), m.end(), kind) for kind, pattern in (("email", EMAIL), ("address", ADDRESS), ("id_number", ID_NUMBER), ("phone", PHONE)) for m in pattern.finditer(t)]
    found = [(a, b, k) for a, b, k in found if k != "phone" or 9 <= sum(c.isdigit() for c in t[a:b]) <= 15]
    rank = {"email": 0, "address": 1, "id_number": 2, "phone": 3}
    out: list[tuple[int, int, str]] = []
    for a, b, k in sorted(found, key=lambda s: (min(rank[s[2]], 2), s[0], -s[1], rank[s[2]])):  # of numbers that overlap the longer
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, k))
    return sorted(out)


def terms(t: str, spans: list[tuple[int, int, str]], a: int, b: int) -> list[str]:
    """The contexts of one, two and three words before and after a mention, and its first and last word."""
    before, after = t[max(0, a - APART) : a], t[b : b + APART]
    if (left := [s for s in spans if a - APART < s[1] <= a]) and not SENTENCE_END.search(t[left[-1][1] : a]):
        before = MARKS[left[-1][2]] + t[left[-1][1] : a]
    if (right := [s for s in spans if b <= s[0] < b + APART]) and not SENTENCE_END.search(t[b : right[0][0]]):
        after = t[b : right[0][0]] + MARKS[right[0][2]]
    at, to = [m.start() for m in TOKEN.finditer(before)], [m.end() for m in TOKEN.finditer(after)]
    out = [f"<{n}" + (before[at[-n] :] if n <= len(at) else "^" + before) for n in (1, 2, 3)]
    out += [f">{n}" + (after[: to[n - 1]] if n <= len(to) else after + "$") for n in (1, 2, 3)]
    words = parts(t[a:b])
    return [re.sub(r"[ \t]+", " ", x).lower() for x in out] + ["=a" + words[0], "=b" + words[-1]]


def mentions(t: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, bool, list[str]]]:
    """(start, end, whether a protected entity stands by, terms) of what may be names."""
    out = []
    for m in CANDIDATE.finditer(t):
        a, b = m.span("name")
        if m["name"].isupper() or NO_NAME.intersection(parts(m["name"])) or any(a < y and x < b for x, y, _ in spans):  # in capitals: headlines and shouting
            continue
        found = terms(t, spans, a, b)
        adjoins = any(mark in x for x in (*found[:2], *found[3:5]) for mark in MARKS.values())
        out.append((a, b, adjoins or any(x >= b + APART or y <= a - APART for x, y, _ in spans), found))
    return out


def small_mentions(t: str, spans: list[tuple[int, int, str]], cues: ahocorasick.Automaton) -> list[tuple[int, int, list[str]]]:
    """(start, end, terms) of pairs of words in small letters beside a context that introduces names."""
    out: dict[tuple[int, int], list[str]] = {}
    low = t.lower()
    if len(low) != len(t):  # letters that change their number with their case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    for last, (side, cue) in cues.iter(low):
        m = SMALL_AFTER.match(t, last + 1) if side == "<" else SMALL_BEFORE.search(t, max(0, last + 1 - len(cue) - APART), last + 1 - len(cue))
        if m and m[1].islower() and not NO_NAME.intersection(parts(m[1])) and not any(m.start(1) < y and x < m.end(1) for x, y, _ in spans):
            out.setdefault(m.span(1), terms(t, spans, *m.span(1)))
    return [(a, b, x) for (a, b), x in out.items()]


FOUND = "doc_id bigint, pii_type string, start int, end int, surface string"
MENTION = ["doc_id", "start", "end", "surface", "terms"]


def _shares(labelled: DataFrame) -> tuple[DataFrame, float]:
    """(term, k, n) of the terms of mentions with a label: n different names, k of them protected; and the share of all."""
    named = labelled.withColumn("name", F.lower("surface"))
    base = named.groupBy("name").agg(F.avg("label").alias("label")).agg(F.avg("label")).first()[0] or 0.0
    each = named.select(F.explode("terms").alias("term"), "name", "label").groupBy("term", "name").agg(F.avg("label").alias("label"))
    return each.groupBy("term").agg(F.sum("label").alias("k"), F.count("*").alias("n")).filter(F.col("n") >= SUPPORT), min(max(base, 1e-6), 0.5)


def _disclosed(named: DataFrame, shares: DataFrame, base: float, words: bool) -> DataFrame:
    """Mentions with their disclosure, from their contexts and, if asked, their own words."""
    known = named.select("doc_id", "start", "end", F.posexplode("terms").alias("at", "term")).join(shares, "term")
    figures = known.groupBy("doc_id", "start", "end").agg(*[F.max(F.when(F.col("at") == i, F.col(c))).alias(f"{c}{i}") for i in range(8) for c in "kn"])
    odds = lambda p: F.log(p / (1 - p)) - math.log(base / (1 - base))
    total: Column = F.lit(0.0)
    spoken: Column = F.lit(0.0)
    for side in ((0, 1, 2), (3, 4, 5), *(((6,), (7,)) if words else ())):
        p: Column = F.lit(base)
        for i in side:
            prior = PRIOR * (1 if len(side) > 1 else 2)
            p = F.when(F.col(f"n{i}").isNull(), p).otherwise((F.col(f"k{i}") + prior * p) / (F.col(f"n{i}") + prior))
        known_as = odds(F.greatest(F.least(p, F.lit(1 - 1e-4)), F.lit(min(1e-4, base / 100))))
        total, spoken = total + known_as, spoken + known_as if len(side) == 1 else spoken
    total = F.when((F.col("surface") != F.lower("surface")) | (spoken > 0), total).otherwise(F.lit(0.0))  # in small letters the words must be known of names
    return named.join(figures, ["doc_id", "start", "end"]).select(*MENTION, total.alias("disclosure"))


def _best() -> Column:
    """Whether no mention that overlaps has a greater disclosure."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    best = F.lit(True)
    for n in (1, 2):
        start, end, other = (F.lead(c, n).over(order) for c in ("start", "end", "disclosure"))
        best = best & ~F.coalesce((start < F.col("end")) & (other > F.col("disclosure")), F.lit(False))
        start, end, other = (F.lag(c, n).over(order) for c in ("start", "end", "disclosure"))
        best = best & ~F.coalesce((end > F.col("start")) & (other >= F.col("disclosure")), F.lit(False))
    return best


def _halves(named: DataFrame) -> DataFrame:
    """(doc_id, start, end) of mentions made of a greeting and half of the name after it ("Thanks, Anna" of "Thanks, Anna Berg").

    A greeting is a word that stands before a comma and a name more often than it ends names written the other way round.
    """
    turned = F.col("surface").contains(", ")
    goes_on = F.coalesce(F.lead("start").over(Window.partitionBy("doc_id").orderBy("start", "end")) < F.col("end"), F.lit(False))
    word = lambda i: F.substring(F.get("terms", F.lit(i)), 3, 1000)
    seen = named.select("doc_id", "start", "end", F.lower("surface").alias("name"), turned.alias("turned"), (turned & goes_on).alias("halves"), word(6).alias("first"), word(7).alias("last"))
    before = seen.filter("halves").groupBy(F.col("first").alias("word")).agg(F.countDistinct("name").alias("halved"))
    behind = seen.filter("not turned").groupBy(F.col("last").alias("word")).agg(F.countDistinct("name").alias("ended"))
    greetings = before.join(behind, "word", "left").filter((F.col("halved") >= SUPPORT) & (F.col("halved") > F.coalesce("ended", F.lit(0))))
    return seen.filter("halves").join(greetings, F.col("first") == F.col("word"), "left_semi").select("doc_id", "start", "end")


def find_personal(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pii_type, start, end, surface) of all personal information."""
    require(documents, id_col, text_col)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["text"]):
                t = plain(text)
                spans = structured(t)
                rows += [(i, kind, x, y, text[x:y], 1.0, []) for x, y, kind in spans]
                rows += [(i, "name", x, y, text[x:y], float(near), found) for x, y, near, found in mentions(t, spans)]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "start", "end", "surface", "label", "terms"])

    texts = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    seen = cut(texts.mapInPandas(scan, FOUND + ", label double, terms array<string>"))
    items = seen.filter("pii_type <> 'name'").select("doc_id", "pii_type", "start", "end", "surface")
    named = seen.filter("pii_type = 'name'").select(*MENTION, "label").dropDuplicates(["doc_id", "start", "end"])
    named = cut(named.join(_halves(named), ["doc_id", "start", "end"], "left_anti"))
    labelled = named
    for turn in range(ROUNDS):
        shares, base = _shares(labelled)
        scored = _disclosed(named, shares, base, words=turn > 0)
        labelled = cut(scored.withColumn("label", (_best() & (F.col("disclosure") >= (NEXT if turn else FIRST))).cast("double")))
    shares, base = _shares(labelled)
    shares = cut(shares)
    everywhere = named.select(*MENTION).unionByName(cut(_small(texts, shares)))
    scored = _disclosed(everywhere, shares, base, words=True)
    names = scored.withColumn("best", _best()).filter(F.col("best") & (F.col("disclosure") >= DISCLOSURE))
    return items.unionByName(names.select("doc_id", F.lit("name").alias("pii_type"), "start", "end", "surface"))


def _small(texts: DataFrame, shares: DataFrame) -> DataFrame:
    """Mentions in small letters beside the contexts of two and three words that mostly introduce names."""
    telling = shares.filter((F.col("k") >= CUE * (F.col("n") + PRIOR)) & F.col("term").rlike("^[<>][23]") & ~F.col("term").rlike(f"^..\\^|\\$$|[{''.join(MARKS.values())}]"))
    cues = [r["term"] for r in telling.select("term").limit(MOST_CUES + 1).collect()]  # contexts, not texts: wordings that many names share
    if len(cues) > MOST_CUES:
        raise ValueError("more contexts than an executor should be sent: raise SUPPORT")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for cue in cues:
            automaton.add_word(cue[2:], (cue[0], cue[2:]))
        automaton.make_automaton()
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["text"]):
                t = plain(text)
                if cues and (found := small_mentions(t, [], automaton)):
                    spans = structured(t)
                    rows += [(i, x, y, text[x:y], terms(t, spans, x, y)) for x, y, _ in found if not any(x < d and c < y for c, d, _ in spans)]
            yield pd.DataFrame(rows, columns=MENTION)

    return texts.mapInPandas(scan, "doc_id bigint, start int, end int, surface string, terms array<string>").dropDuplicates(["doc_id", "start", "end"])


def sanitise(documents: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with every found span replaced by its placeholder; rows of one id must hold one text."""
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "pii_type"))).alias("__spans")).withColumnRenamed("doc_id", "__span_of")

    @F.pandas_udf("string")
    def replace(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, spans):
            if t is not None and found is not None and len(found):
                parts, at = [], 0
                for s in found:
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], PLACEHOLDERS[s["pii_type"]]]
                        at = s["end"]
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    joined = documents.join(spans, documents[id_col] == F.col("__span_of"), "left")
    return joined.withColumn(text_col, replace(F.col(text_col), F.col("__spans"))).drop("__span_of", "__spans")
