"""Typed rows from HTML, JSON-LD and XML pages.

``extract`` runs a declarative schema over pages in Arrow batches: each field names a selector (tag, id, class or
attribute tests, nested by blanks), what to take (text, an attribute, inner HTML) and whether it repeats, with nested
fields for rows.  Small well-formed pieces are plain Column expressions.  A page that cannot be read gives null fields.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else c.text() for c in self.children)

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [Node("", {})]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.stack[1:]):
            while self.stack.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def parse_html(page: str) -> Node:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.stack[0]


_STEP = re.compile(r"([\w*-]*)((?:[#.][\w-]+|\[[^\]]+\])*)")


def _matches(n: Node, step: str) -> bool:
    m = _STEP.fullmatch(step)
    if not m or (m[1] and m[1] != "*" and n.tag != m[1]):
        return False
    for test in re.findall(r"[#.][\w-]+|\[[^\]]+\]", m[2]):
        if test[0] == "#" and n.attrs.get("id") != test[1:] or test[0] == "." and test[1:] not in n.attrs.get("class", "").split():
            return False
        if test[0] == "[":
            name, op, value = re.fullmatch(r"\[([\w-]+)(?:([*^]?=)\"?([^\"\]]*)\"?)?\]", test).groups()
            have = n.attrs.get(name)
            if have is None or op == "=" and have != value or op == "*=" and value not in have or op == "^=" and not have.startswith(value):
                return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Nodes in document order that fit the last step below ones that fit the steps before."""
    found = [root]
    for step in selector.split():
        nodes, seen = [], set()
        for r in found:
            for n in r.walk():
                if id(n) not in seen and _matches(n, step):
                    seen.add(id(n))
                    nodes.append(n)
        found = nodes
    return found


HEADINGS = frozenset("h1 h2 h3 h4 div".split())


def section(root: Node, heading: str) -> set[int]:
    """The nodes, by identity, from a heading of this text on to the next one with its tag and class."""
    inside: set[int] = set()
    kind = None
    for n in root.walk():
        if n.tag in HEADINGS:
            if kind is None:
                if " ".join(n.text().split()) == heading:
                    kind = n.tag, n.attrs.get("class")
                continue
            if kind == (n.tag, n.attrs.get("class")):
                break
        if kind is not None:
            inside.add(id(n))
    return inside


@dataclass(frozen=True)
class Take:
    """One field of a schema."""

    selector: str
    attribute: str | None = None  # else the text
    many: bool = False
    rows: dict[str, Take] = field(default_factory=dict)
    under: str | None = None  # only what stands between a heading of this text and the next heading of its kind

    def ddl(self) -> str:
        inner = f"struct<{','.join(f'{k}:{t.ddl()}' for k, t in self.rows.items())}>" if self.rows else "string"
        return f"array<{inner}>" if self.many else inner

    def read(self, root: Node) -> Any:
        nodes = select(root, self.selector) if self.selector else [root]
        if self.under:
            inside = section(root, self.under)
            nodes = [n for n in nodes if id(n) in inside]
        one = (lambda n: {k: t.read(n) for k, t in self.rows.items()}) if self.rows else (lambda n: n.attrs.get(self.attribute) if self.attribute else " ".join(n.text().split()) or None)
        values = (v for n in nodes if (v := one(n)) is not None)
        return list(values) if self.many else next(values, None)


def extract(pages: DataFrame, schema: dict[str, Take], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, a column per field) of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, page in zip(b[id_col], b[html_col]):
                try:
                    root = parse_html(page or "")
                    rows.append((i, *(t.read(root) for t in schema.values())))
                except (RecursionError, ValueError, AssertionError):
                    rows.append((i, *(None for _ in schema)))
            yield pd.DataFrame(rows, columns=[id_col, *schema])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {kind}, " + ", ".join(f"{k} {t.ddl()}" for k, t in schema.items()))


# --- small pieces as expressions ----------------------------------------------------------------------------------------
def _or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def sidebar_field(page: Column, label: str) -> Column:
    """The text behind a label such as ``Studios:``; N/A, None and a question mark are none."""
    raw = F.regexp_extract(page, rf"(?s)<span[^>]*>\s*{re.escape(label)}:?\s*</span>(.*?)</div>", 1)
    value = _or_null(F.regexp_replace(F.regexp_replace(raw, "<[^>]+>", ""), r"\s+", " "))
    return F.when(~F.coalesce(value.isin("N/A", "?", "None", "None found, add some"), F.lit(False)), value)


def json_ld(page: Column) -> Column:
    """The first JSON-LD block, as text for ``from_json`` or ``try_parse_json``."""
    return _or_null(F.regexp_extract(page, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1))


def name_and_native(header: Column) -> Column:
    """`Name (Native)` in its two parts."""
    pattern = r"^\s*(.*?)\s*(?:\(([^()]*)\))?\s*$"
    return F.struct(_or_null(F.regexp_extract(header, pattern, 1)).alias("name"), _or_null(F.regexp_extract(header, pattern, 2)).alias("native"))


def episode_title_info(header: Column, subtitle: Column) -> Column:
    """Title, romaji, Japanese and flags of `#12 - Title Filler` over `Romaji (Japanese)`."""
    body = F.regexp_replace(header, r"^\s*#\d+\s*-\s*", "")
    flags = r"(?i)\s+(?:Filler|Recap)(?:\s+(?:Filler|Recap))*\s*$"
    below = name_and_native(subtitle)
    return F.struct(_or_null(F.regexp_replace(body, flags, "")).alias("title"), below["name"].alias("romaji"), below["native"].alias("japanese"), body.rlike(r"(?i)\bFiller\s*(?:Recap)?\s*$").alias("filler"), body.rlike(r"(?i)\bRecap\s*(?:Filler)?\s*$").alias("recap"))


def episode_count(page: Column) -> Column:
    """1155 of `(1,155/Unknown`; 0 if there is none."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(page, r"\(([\d,]+)\s*/", 1), ",", "").try_cast("int"), F.lit(0))


def trailer(embed_url: Column) -> Column:
    key = F.nullif(F.regexp_extract(embed_url, r"/(?:embed|vi)/([\w-]{6,})", 1), F.lit(""))
    return F.when(key.isNotNull(), F.struct(F.concat(F.lit("https://www.youtube.com/watch?v="), key).alias("source"), F.concat(F.lit("https://img.youtube.com/vi/"), key, F.lit("/hqdefault.jpg")).alias("thumbnail")))


def own_pictures(urls: Column) -> Column:
    return F.filter(urls, lambda u: u.contains("myanimelist.net") & u.contains("/images/anime/"))


def season_from_path(path: Column) -> Column:
    return F.upper(_or_null(F.regexp_extract(path, r"(?i)(winter|spring|summer|fall)", 1)))


def alternative_title(aka: Column) -> Column:
    return _or_null(F.regexp_replace(aka, r"(?i)^\s*alt(?:ernative)? titles?:\s*", ""))


def related_entries(entries: Column) -> Column:
    """Relation, title and address of raw related rows; rows without either of the last two are left out."""
    kept = F.filter(entries, lambda e: (F.length(F.trim(e["title"])) > 0) & (F.length(e["url"]) > 0))
    return F.transform(
        kept,
        lambda e: F.struct(
            F.regexp_replace(F.trim(e["relation"]), r":\s*$", "").alias("relation"), F.trim(F.regexp_replace(e["title"], r"\s*\([^()]*\)\s*$", "")).alias("title"), _or_null(F.regexp_extract(e["title"], r"\(([^()]*)\)\s*$", 1)).alias("type"),
            e["url"].alias("source"), e["url"].contains("/anime/").alias("is_anime"),
        ),
    )


def biography(section: str | None) -> dict[str, Any]:
    """Key-value lines, what is hidden behind them, and the prose, of a biography written with line breaks."""
    attributes: dict[str, str] = {}
    hidden: dict[str, str] = {}
    prose, secret = [], []
    for line in re.split(r"(?i)<br\s*/?>", section or ""):
        covered = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.findall(r"(?is)<(?:div|span)[^>]*spoiler[^>]*>(.*?)</(?:div|span)>", line)]
        shown = html.unescape(re.sub(r"(?is)<(?:div|span)[^>]*spoiler[^>]*>.*?</(?:div|span)>|<[^>]+>", "", line)).strip().rstrip(",").strip()
        key, colon, value = shown.partition(":")
        name = key.strip().lower().replace(" ", "_")
        if colon and 0 < len(key) < 30:
            if name and value.strip():
                attributes[name] = value.strip()
            if name and any(covered):
                hidden[name] = [c for c in covered if c][-1]
            continue
        prose.append(shown)
        secret += [c for c in covered if c]
    join = lambda xs: " ".join(" ".join(xs).split()) or None
    return {"attributes": attributes, "spoilers": hidden, "description": join(prose), "description_spoiler": join(secret)}


def with_biography(df: DataFrame, section_col: str, id_col: str) -> DataFrame:
    """(id, attributes, spoilers, description, description_spoiler) of biography sections."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [biography(s) for s in b[section_col]]
            yield pd.DataFrame({id_col: b[id_col].tolist(), **{k: [x[k] for x in found] for k in ("attributes", "spoilers", "description", "description_spoiler")}})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, section_col).mapInPandas(run, f"{id_col} {kind}, attributes map<string,string>, spoilers map<string,string>, description string, description_spoiler string")


def first_language_attributes(blocks: Column) -> Column:
    """Of attribute maps, English first, each key's first value."""
    return F.aggregate(blocks, F.create_map().cast("map<string,string>"), lambda m, b: F.map_concat(m, F.map_filter(b, lambda k, _: ~F.map_contains_key(m, k))))


# --- schemas ------------------------------------------------------------------------------------------------------------
CHARACTER_ROWS = {"name": Take("a"), "url": Take("a", "href"), "role": Take("small")}
MAL_ANIME = {"title": Take("h1.title-name"), "synopsis": Take("p[itemprop=description]"), "score": Take("div.score-label"), "genres": Take("span[itemprop=genre]", many=True), "cover": Take("img[itemprop=image]", "data-src"), "related": Take("table.entries-table tr", many=True, rows={"relation": Take("td.ar"), "title": Take("li a"), "url": Take("li a", "href")})}
PLANET_ANIME = {"name": Take("h1[itemprop=name]"), "alt_title": Take("h2.aka"), "rank": Take("div[itemprop=aggregateRating]"), "tags": Take("div.tags li a", many=True), "studios": Take("section.entryBar a[href*=/studios/]", many=True), "cover": Take("img.screenshots", "src")}
ANISEARCH_ANIME = {"title": Take("h1#htitle"), "type": Take("div.type"), "studio": Take("div.company a"), "studio_url": Take("div.company a", "href"), "genres": Take("ul.cloud a.gg", many=True), "tags": Take("ul.cloud a.gt", many=True), "cover_image": Take("img#details-cover", "src")}
_OGRAPHY = {"title": Take("a[href*=/]"), "url": Take("a[href*=/]", "href"), "role": Take("small")}
MAL_CHARACTER = {
    "header": Take("h2.normal_header"),
    "image": Take("img.portrait", "data-src"),
    "animeography": Take("tr", many=True, under="Animeography", rows=_OGRAPHY),
    "mangaography": Take("tr", many=True, under="Mangaography", rows=_OGRAPHY),
    "voice_actors": Take("tr", many=True, under="Voice Actors", rows={"name": Take("a[href*=/people/]"), "url": Take("a[href*=/people/]", "href"), "language": Take("small")}),
}
MAL_EPISODE = {
    "header": Take("h2.fs18"),
    "subtitle": Take("p.fn-grey2"),
    "box": Take("div.di-tc.ar"),
    "characters": Take("tr", many=True, rows={"name": Take("a.fw-b[href*=/character/]"), "url": Take("a.fw-b[href*=/character/]", "href"), "role": Take("small"), "voice": Take("p.pb8")}),
    "staff": Take("tr", many=True, rows={"name": Take("a.fw-b[href*=/people/]"), "url": Take("a.fw-b[href*=/people/]", "href"), "role": Take("p.pr12")}),
}
_PLANET_ROLES = {"title": Take("a[href^=/]"), "url": Take("a[href^=/]", "href"), "cells": Take("td", many=True, rows={"text": Take("")}), "voices": Take("div.flag", many=True, rows={"flag": Take("", "class"), "name": Take("a[href^=/people/]"), "url": Take("a[href^=/people/]", "href")})}
PLANET_CHARACTER = {
    "name": Take("h1[itemprop=name]"),
    "aka": Take("h2.aka"),
    "bar": Take("section.entryBar div", many=True),
    "titles": Take("h3.EntryMetadata__title", many=True, rows={"text": Take("")}),
    "values": Take("div.EntryMetadata__value", many=True, rows={"text": Take("")}),
    "description": Take("div[itemprop=description]"),
    "tags": Take("a[href^=/characters/tags/]", many=True),
    "anime_roles": Take("tr", many=True, under="Anime Roles", rows=_PLANET_ROLES),
    "manga_roles": Take("tr", many=True, under="Manga Roles", rows=_PLANET_ROLES),
    "loved": Take("a[href*=/characters/top-loved]"),
}
_ANISEARCH_RELATION = {"relation_type": Take("th span"), "title": Take("th a"), "url": Take("th a", "href")}
ANISEARCH_RELATIONS = {"anime": Take("section#relations_anime tbody tr", many=True, rows=_ANISEARCH_RELATION), "manga": Take("section#relations_manga tbody tr", many=True, rows=_ANISEARCH_RELATION)}
ANISEARCH_CHARACTER = {
    "name": Take("h1#htitle"),
    "blocks": Take("ul.infoblock li", many=True, rows={"language": Take("div.title", "lang"), "native": Take("span.grey"), "actors": Take("a[href^=person/]", many=True)}),
    "tags": Take("ul.cloud a.gt", many=True),
    "ography": Take("ul.covers a", many=True, rows={"title": Take("span.title"), "url": Take("", "href")}),
}
ANISEARCH_EPISODES = {
    "rows": Take(
        "table.episodes tr[data-episode=true]",
        many=True,
        rows={
            "number": Take("th[itemprop=episodeNumber]"),
            "runtime": Take("td[data-title=Runtime] div[lang=ja]"),
            "released": Take("td[data-title^=Date] div[lang=ja]"),
            "title": Take("td[data-title=Title] div[lang=en] span[itemprop=name]"),
            "title_ja": Take("td[data-title=Title] div[lang=ja] span[itemprop=name]"),
        },
    )
}
REFERENCES = {"rows": Take("table tr", many=True, rows=CHARACTER_ROWS)}

# Languages of voice actors by the flag or the code a page shows; fixed values.
FLAGS = {"JP": "jp", "US": "us", "ES": "es", "FR": "fr", "DE": "de", "KO": "ko"}
LANGUAGES = {"ja": "Japanese", "en": "English", "de": "German", "fr": "French", "it": "Italian", "es": "Spanish", "ko": "Korean", "zh": "Chinese", "pt": "Portuguese"}


def named_rows(rows: Column) -> Column:
    """Rows that show a title or a name and lead somewhere."""
    return F.filter(rows, lambda r: F.coalesce(F.length(r["url"]) > 0, F.lit(False)) & (F.length(r["title"]) > 0))


def planet_roles(rows: Column) -> Column:
    """Title, address, role and voice actors by language of a character's roles; the role stands in the second cell."""

    def voice(v: Column) -> Column:
        flag = F.regexp_extract(v["flag"], r"\bflag([A-Z]{2})\b", 1)
        return F.struct(v["name"].alias("name"), F.try_element_at(F.create_map(*[F.lit(x) for pair in FLAGS.items() for x in pair]), flag).alias("language"), v["url"].alias("url"))

    whole = F.filter(named_rows(rows), lambda r: F.size(r["cells"]) > 1)
    return F.transform(
        whole,
        lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"), _or_null(r["cells"][1]["text"]).alias("role"), F.filter(F.transform(r["voices"], voice), lambda v: v["language"].isNotNull()).alias("voice_actors")),
    )


def entry_bar(cells: Column) -> Column:
    """Gender and hair colour of the bar below a character's name."""
    after = lambda label: F.try_element_at(F.filter(F.transform(cells, lambda c: _or_null(F.regexp_extract(c, rf"(?i){label}:\s*(.+)", 1))), lambda v: v.isNotNull()), F.lit(1))
    return F.struct(after("Gender").alias("gender"), after("Hair Color").alias("hair_color"))


def listed_names(aka: Column) -> Column:
    """The names of `Aka: A, B`."""
    parts = F.split(F.regexp_replace(aka, r"(?i)^\s*aka:\s*", ""), ",")
    return F.filter(F.transform(parts, lambda n: F.trim(n)), lambda n: F.length(n) > 0)


def titled_values(titles: Column, values: Column) -> Column:
    """A map of titles and values standing side by side, blanks left out."""
    pairs = F.zip_with(titles, values, lambda k, v: F.struct(F.trim(k["text"]).alias("k"), F.trim(v["text"]).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p: (F.length(p["k"]) > 0) & (F.length(p["v"]) > 0)))


def block_actors(blocks: Column) -> Column:
    """Name and language of the voice actors of a character's language blocks."""
    language = lambda code: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), code), code)
    return F.flatten(F.transform(blocks, lambda b: F.transform(b["actors"], lambda a: F.struct(a.alias("name"), language(b["language"]).alias("language")))))


def roles_of(ography: Column) -> Column:
    """Titles and addresses as roles whose kind is not known."""
    return F.transform(named_rows(ography), lambda o: F.struct(o["title"].alias("title"), o["url"].alias("url"), F.lit(None).cast("string").alias("role")))


def episode_rows(rows: Column) -> Column:
    """Number, flags, seconds, date and titles of an episode table; rows without a number are left out."""

    def typed(r: Column) -> Column:
        native = name_and_native(r["title_ja"])
        return F.struct(
            F.regexp_extract(r["number"], r"(\d+)", 1).try_cast("int").alias("episode_number"), F.coalesce(r["number"].rlike("(?i)filler"), F.lit(False)).alias("is_filler"), F.coalesce(r["number"].rlike("(?i)recap"), F.lit(False)).alias("is_recap"),
            (F.regexp_extract(r["runtime"], r"(?i)(\d+)\s*min", 1).try_cast("int") * 60).alias("duration"), r["released"].alias("aired"), r["title"].alias("title"), native["name"].alias("title_romaji"), native["native"].alias("title_japanese"),
        )

    return F.filter(F.transform(rows, typed), lambda e: e["episode_number"].isNotNull())


# Episode, character and whole-record shapes of one XML feed; fixed values.
ANIME_XML = """id STRING, type STRING, episodecount INT, startdate STRING, enddate STRING, description STRING, titles STRUCT<title: ARRAY<STRUCT<_VALUE: STRING, _type: STRING, `_xml:lang`: STRING>>>,
 ratings STRUCT<permanent: STRUCT<_VALUE: DOUBLE, _count: BIGINT>>, relatedanime STRUCT<anime: ARRAY<STRUCT<_VALUE: STRING, _id: STRING, _type: STRING>>>,
 characters STRUCT<character: ARRAY<STRUCT<_id: STRING, _type: STRING, name: STRING, gender: STRING, picture: STRING>>>,
 episodes STRUCT<episode: ARRAY<STRUCT<_id: STRING, epno: STRUCT<_VALUE: STRING, _type: STRING>, length: INT, airdate: STRING, title: ARRAY<STRUCT<_VALUE: STRING, `_xml:lang`: STRING>>>>>"""


def anime_from_xml(df: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Titles by kind, dates, rating, characters, episodes and relations of an XML record; a malformed one gives nulls."""
    x = F.from_xml(F.col(xml_col), ANIME_XML, {"mode": "PERMISSIVE", "rowTag": "anime"})
    d = df.withColumn("x", x)
    written = F.coalesce(F.col("x.titles.title"), F.array().cast("array<struct<_VALUE:string,_type:string,`_xml:lang`:string>>"))
    titles = F.transform(written, lambda t: F.struct(t["_VALUE"].alias("_VALUE"), t["_type"].alias("_type"), t["_xml:lang"].alias("lang")))
    pick = lambda test: F.transform(F.filter(titles, test), lambda t: t["_VALUE"])
    official = lambda lang: F.try_element_at(pick(lambda t: (t["_type"] == "official") & (t["lang"] == lang)), F.lit(1))
    return d.select(
        *[F.col(c) for c in df.columns if c != xml_col], F.try_element_at(pick(lambda t: t["_type"] == "main"), F.lit(1)).alias("title"), official("en").alias("title_english"), official("ja").alias("title_japanese"),
        pick(lambda t: t["_type"].isin("synonym", "short")).alias("synonyms"), F.col("x.type").alias("type"), F.col("x.episodecount").alias("episode_count"), F.col("x.startdate").alias("start_date"), F.col("x.enddate").alias("end_date"),
        F.col("x.ratings.permanent._VALUE").alias("score"), F.col("x.ratings.permanent._count").alias("scored_by"), F.col("x.characters.character").alias("characters"), F.col("x.episodes.episode").alias("episodes"), F.col("x.relatedanime.anime").alias("related"),
    )
