"""Passages of evaluation items found in a training corpus, also cut, altered or rearranged.

Seeds are three words of an item, in order and with up to ``APART - 1`` words left open between two of them; words of a
document stand for item words also with a typo.  Every agreeing word of an alignment that counts stands in such a seed,
so an item whose seeds in a document cover too few of its words to make a case is passed over and no case is lost.  The
seeds go to all executors.  Around those of its seeds that hold own words, an item is aligned by Smith-Waterman over
words, where a word with a typo counts as nearly the same.  Further alignments of the words left over are added, which
finds passages in another order.

An alignment counts only if it carries words of the item's own: a word is shared where it stands in an n-gram of many
items; items that repeat one another, wholly or for the most part, count as one there.  A pair is a case if the counted
alignments span at least ``STRETCH`` words of the item (or its whole passage, if shorter) and most of these agree.

Cases: null and empty texts match nothing; markup is left out; case, accents and punctuation make no difference;
copies of a document count each; an item under several ids, or a passage that makes up most of several items, is found
under each; documents of any length are read whole, in windows around their seeds; items of under three words are looked
for by each word; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.functions.names import deletions, edit_distance
from catalith.runtime import require

N = 3  # words of an n-gram
REPEATED = 0.6  # of the n-grams of the shorter of two items from which they count as one where wording is counted
SHARED = 0.02  # of the items (and three at least) from which an n-gram is common wording
STRETCH, AGREED = 15, 12  # words of the item spanned, and of these agreeing
OWN_SHARE, OWN_LEAST, PART_LEAST, PART_AGREED = 0.7, 2, 5, 0.75
MATCH, NEAR, MISS, GAP = 1.0, 0.8, -1.2, -0.9
APART = 4  # words between two of a seed, and of a part
MOST_WORDS = 300_000  # words of items whose index is sent to the executors at once
PAIRS = 1 << 22  # places of the table that sorts out pairs of words no seed begins or ends with
MOST_KNOWN, AT_ONCE = 200_000, 20_000  # words of documents a task remembers, and looks up together, about
WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+(?:[-'’][^\W_]+)*")


def words(text: str) -> list[str]:
    """Words in lower case without accents, markup and punctuation; of Japanese and Chinese the single signs."""
    plain = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), html.unescape(re.sub(r"<[^<>]{1,200}>", " ", text)))
    plain = re.sub(r"[\u00ad\u200b-\u200d\ufeff]|(?<=\w)-\s*\n\s*(?=\w)", "", plain)  # hyphenation and invisible signs
    plain = unicodedata.normalize("NFKC", re.sub(r"[\ud800-\udfff]", "", plain)).lower()
    return WORD.findall(plain.replace("’", "'"))


def grams(ws: list[str], n: int = N) -> list[tuple[str, ...]]:
    return list(zip(*[ws[i:] for i in range(n)]))


def patterns(ws: list[str]) -> list[tuple[tuple[int, ...], tuple]]:
    """n-grams, and those with words left open between, as wording into which items put their own words: places, pattern."""
    out: list = [((k, k + 1, k + 2), g) for k, g in enumerate(grams(ws))]
    for shape in ((0, 2, 3), (0, 1, 3), (0, 2, 4)):
        out += [(tuple(k + s for s in shape), (shape, *(ws[k + s] for s in shape))) for k in range(len(ws) - shape[-1])]
    return out


class Item(NamedTuple):
    item_id: int
    words: list[str]
    own: np.ndarray  # positions of its own words, outside wording it shares
    near: dict[str, list[str]]  # words of the item by what is left of them without a letter or two


class Index(NamedTuple):
    items: list[Item]
    ids: dict[str, int]  # of the words of all items
    near: dict[str, list[str]]  # words of all items by what is left of them without a letter or two
    pairs: np.ndarray  # whether a hashed pair of words stands in a seed
    seeds: np.ndarray  # keys in order; of each, where it stands is in ``places`` from ``first`` on
    first: np.ndarray
    places: np.ndarray  # of the three words among those of all items
    starts: np.ndarray  # where an item's words begin among those of all items, and their end
    own: np.ndarray


def repeated(split: dict[int, list[str]]) -> list[list[int]]:
    """The items in groups of those that repeat one another, wholly or for the most part."""
    held = {i: set(grams(ws)) or {tuple(ws)} for i, ws in split.items()}
    holders: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for i, gs in held.items():
        for g in gs:
            holders[g].append(i)
    group = {i: [i] for i in split}
    for i, gs in held.items():
        for j, n in Counter(j for g in gs for j in holders[g] if j < i).items():
            if n >= REPEATED * min(len(gs), len(held[j])) and group[i] is not group[j]:
                group[j] += group[i]
                for k in group[i]:
                    group[k] = group[j]
    return list({id(members): members for members in group.values()}.values())


def prepare_items(rows: list[tuple[int, str | None]], indexed: bool = True) -> tuple[dict[int, Item], Index | None]:
    """The items made ready, and the index of their seeds."""
    split = {i: words(t) for i, t in rows if t}
    groups = repeated(split)
    df = Counter(g for group in groups for g in {g for i in group for _, g in patterns(split[i])})
    common = max(3, SHARED * len(groups))
    items: dict[int, Item] = {}
    for i, ws in split.items():
        own = np.ones(len(ws), bool)
        for places, g in patterns(ws):
            if df[g] >= common:
                own[list(places)] = False
        near: dict[str, list[str]] = defaultdict(list)
        for w in set(ws):
            if len(w) > 4:
                for d in deletions(w, 1 if len(w) < 8 else 2):
                    near[d].append(w)
        items[i] = Item(i, ws, own, dict(near))
    return items, build_index(list(items.values())) if indexed else None


def build_index(ready: list[Item]) -> Index:
    """The index of the seeds of some items."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(w for item in ready for w in item.words))}
    left: dict[str, set[str]] = defaultdict(set)
    for item in ready:
        for d, ws in item.near.items():
            left[d].update(ws)
    starts = np.cumsum([0, *(len(item.words) for item in ready)])
    own = np.concatenate([np.zeros(0, bool), *(item.own for item in ready)])
    keys, places, pairs = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)], np.zeros(PAIRS, bool)
    for start, item in zip(starts, ready):
        x = np.array([ids[w] for w in item.words], np.int64)
        for d in range(1, APART + 1):
            for e in range(d + 1, d + APART + 1):
                at = np.arange(max(0, len(x) - e))
                a, b, c = x[at], x[at + d], x[at + e]
                pairs[(a * len(ids) + b) % PAIRS] = pairs[(b * len(ids) + c) % PAIRS] = True
                keys.append((a * len(ids) + b) * len(ids) + c)
                places.append(start + np.stack([at, at + d, at + e], axis=1))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    seeds, first = np.unique(key[order], return_index=True)
    return Index(ready, ids, {d: sorted(ws) for d, ws in left.items()}, pairs, seeds, np.append(first, len(key)), np.concatenate(places)[order], starts, own)


def alike(index: Index, w: str) -> list[int]:
    """The item words a word may stand for."""
    found = {w} & index.ids.keys()
    if len(w) > 4:
        most = 1 if len(w) < 8 else 2
        like = {v for d in deletions(w, most) for v in index.near.get(d, ())} - found
        found |= {v for v in like if edit_distance(w, v, most) <= most}
    return [index.ids[v] for v in found]


def follow(count: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, place) for each of the count[k] places from begin[k] on."""
    k = np.repeat(np.arange(len(count)), count)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count) + begin[k]


def supported(index: Index, places: np.ndarray, where: np.ndarray, n: int) -> list[int]:
    """Where seeds with own words begin that have n agreeing words about them, as close as the words of a part are."""
    far = (n - 1) * APART
    out: dict[int, None] = {}
    low, high = np.searchsorted(where, where - far), np.searchsorted(where, where + far, "right")
    for k in np.flatnonzero(index.own[places].any(axis=1)).tolist():
        t = int(where[k])
        if t not in out:
            about = places[low[k] : high[k]]
            about = about[(about[:, 0] >= places[k, 0] - far) & (about[:, 0] <= places[k, 0] + far)]
            if len(set(about.ravel().tolist())) >= n:
                out[t] = None
    return list(out)


def seeded(index: Index, docs: list[list[str]], known: dict[str, list[int]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Windows around seeds with own words, by (document, place of the item), where the item's seeds cover words enough for a case.

    ``known`` remembers what words stand for.
    """
    if len(known) > MOST_KNOWN:
        known.clear()
    begins = np.cumsum([0, *(len(ws) + APART for ws in docs)])
    at: list[int] = []
    word: list[int] = []
    for begin, ws in zip(begins.tolist(), docs):
        for p, w in enumerate(ws, begin):
            if w not in known:
                known[w] = alike(index, w)
            for v in known[w]:
                at.append(p)
                word.append(v)
    p, x, n = np.array(at, np.int64), np.array(word, np.int64), len(index.ids)
    low = np.searchsorted(p, p + 1)
    a, b = follow(np.searchsorted(p, p + APART, "right") - low, low)
    good = index.pairs[(x[a] * n + x[b]) % PAIRS]
    a, b = a[good], b[good]
    low = np.searchsorted(a, b)
    ab, bc = follow(np.searchsorted(a, b, "right") - low, low)
    key = (x[a[ab]] * n + x[b[ab]]) * n + x[b[bc]]
    seed = np.searchsorted(index.seeds, key)
    good = np.flatnonzero(np.append(index.seeds, -1)[seed] == key)
    begin = p[a[ab[good]]]
    ends = np.searchsorted(begin, begins)
    lengths = np.diff(index.starts)
    enough = np.minimum(AGREED, 0.8 * lengths)
    some = np.flatnonzero(lengths)  # items of no words have no place of their own
    out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for d in np.flatnonzero(np.diff(ends)).tolist():
        found = good[ends[d] : ends[d + 1]]
        hit, at_place = follow(index.first[seed[found] + 1] - index.first[seed[found]], index.first[seed[found]])
        places = index.places[at_place]
        covered = np.zeros(len(index.own), bool)
        covered[places] = True
        likely = some[(np.add.reduceat(covered, index.starts[some], dtype=int) >= enough[some]) & (np.add.reduceat(covered & index.own, index.starts[some], dtype=int) >= OWN_LEAST)]
        for k in likely.tolist():
            low, high = index.starts[k], index.starts[k + 1]
            if reachable_words(index.items[k], covered[low:high]) >= enough[k]:
                mine = (places[:, 0] >= low) & (places[:, 0] < high)
                words_hit, where = places[mine], begin[ends[d] : ends[d + 1]][hit[mine]] - begins[d]
                for x, y in windows(supported(index, words_hit, where, least(index.items[k])[0]), int(lengths[k]), len(docs[d])):
                    inside = np.zeros(lengths[k], bool)
                    inside[words_hit[(where >= x) & (where < y)] - low] = True
                    if reachable_words(index.items[k], inside) >= enough[k]:
                        out[d, k].append((x, y))
    for k, item in enumerate(index.items):
        if 0 < len(item.words) < 3:
            wanted = {index.ids[w] for w in item.words}
            for d, ws in enumerate(docs):
                if t := [t for t, w in enumerate(ws) if wanted.intersection(known[w])]:
                    out[d, k] = windows(t, len(item.words), len(ws))
    return out


def least(item: Item) -> tuple[int, int]:
    """Words of a part, and own words of it, at least."""
    return min(PART_LEAST, len(item.words)), min(OWN_LEAST, len(item.words))


def reachable_words(item: Item, hit: np.ndarray) -> int:
    """How many of the item's words that are hit lie in stretches that could be parts: no case has more agreeing words."""
    at = np.flatnonzero(hit)
    n, own_least = least(item)
    if len(at) < n:
        return 0
    own, own_hit = (np.concatenate([[0], np.cumsum(x)]) for x in (item.own, item.own & hit))
    k = np.arange(len(at))
    first, last = at[:, None], at[None, :] + 1
    part = k[None, :] - k[:, None] + 1 >= np.maximum(n, PART_AGREED * (last - first))
    part &= own_hit[last] - own_hit[first] >= np.maximum(own_least, OWN_SHARE * (own[last] - own[first]))
    ends = np.maximum.accumulate(np.where(part, k[None, :], -1).max(axis=1))  # of the stretches begun so far
    return int((ends >= k).sum())


def score_matrix(item: Item, doc: list[str]) -> np.ndarray:
    places: dict[str, list[int]] = defaultdict(list)
    for k, w in enumerate(item.words):
        places[w].append(k)
    s = np.full((len(item.words), len(doc)), MISS, np.float32)
    known: dict[str, list[tuple[int, float]]] = {}
    for j, w in enumerate(doc):
        if w not in known:
            hits = [(k, MATCH) for k in places.get(w, ())]
            if not hits and len(w) > 4:
                most = 1 if len(w) < 8 else 2
                like = {v for d in deletions(w, most) for v in item.near.get(d, ()) if edit_distance(w, v, most) <= most}
                hits = [(k, NEAR) for v in like for k in places[v]]
            known[w] = hits
        for k, x in known[w]:
            s[k, j] = x
    return s


def local_alignment(s: np.ndarray) -> tuple[list[tuple[int, int]], float]:
    """The best local alignment under a score matrix: its (item word, document word) pairs, and its score."""
    n, m = s.shape
    h = np.zeros((n + 1, m + 1), np.float32)
    ramp = -GAP * np.arange(m + 1, dtype=np.float32)
    for i in range(1, n + 1):
        row = h[i]
        np.maximum(h[i - 1, :-1] + s[i - 1], h[i - 1, 1:] + GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        np.maximum(row, np.maximum.accumulate(row + ramp) - ramp, out=row)  # gaps along the row
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, pairs = float(h[i, j]), []
    while i > 0 and j > 0 and h[i, j] > 1e-4:
        if abs(h[i, j] - (h[i - 1, j - 1] + s[i - 1, j - 1])) < 1e-3:
            i, j = i - 1, j - 1
            pairs.append((int(i), int(j)))
        elif abs(h[i, j] - (h[i - 1, j] + GAP)) < 1e-3:
            i -= 1
        else:
            j -= 1
    return pairs[::-1], score


def parts(hits: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The agreeing words of an alignment, split where more than APART words of either side lie between."""
    out: list[list[tuple[int, int]]] = []
    for a, b in hits:
        if out and a - out[-1][-1][0] <= APART and b - out[-1][-1][1] <= APART:
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return out


def judge(item: Item, doc: list[str]) -> tuple[int, int]:
    """(words of the item spanned, words agreeing) of the alignments that count, in one window of a document."""
    s = score_matrix(item, doc)
    if reachable_words(item, (s > 0).any(axis=1)) < min(AGREED, 0.8 * len(item.words)):
        return 0, 0  # too few to make a case
    n, own_least = least(item)
    spanned = agreed = 0
    while True:  # each alignment takes its words away, so the score falls below the least of a part
        pairs, score = local_alignment(s)
        if score <= 0 or score < n - 1:
            break
        hits = [(a, b) for a, b in pairs if s[a, b] > 0]
        for part in parts(hits):
            first, last = part[0][0], part[-1][0]
            own = item.own[first : last + 1].sum()
            own_hits = sum(bool(item.own[a]) for a, _ in part)
            if len(part) >= max(n, PART_AGREED * (last - first + 1)) and own_hits >= max(own_least, OWN_SHARE * own):
                spanned += last - first + 1
                agreed += len(part)
        for a, b in hits:
            s[a, :] = s[:, b] = MISS
    return spanned, agreed


def is_case(item: Item, spanned: int, agreed: int) -> bool:
    """A stretch, or of an item shorter than one nearly all, with most words agreeing."""
    return spanned >= min(STRETCH, 0.9 * len(item.words)) and agreed >= max(min(AGREED, 0.8 * len(item.words)), PART_AGREED * spanned)


def windows(at: list[int], size: int, length: int) -> list[tuple[int, int]]:
    """Stretches of a document around its seeds, apart where no alignment can reach from one to the next."""
    out: list[tuple[int, int]] = []
    reach = size + size // 2 + 20
    for p in sorted(at):
        a, b = max(0, p - reach), min(length, p + N + reach)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def cases(index: Index, docs: list[list[str]], known: dict[str, list[int]]) -> Iterator[tuple[int, int, int, int]]:
    """(document, item_id, spanned, agreed) of the words of some documents."""
    for (d, k), around in seeded(index, docs, known).items():
        item, ws = index.items[k], docs[d]
        best = max((judge(item, ws[x:y]) for x, y in around), key=lambda r: (is_case(item, *r), r))
        if is_case(item, *best):
            yield d, item.item_id, int(best[0]), int(best[1])


def leaked(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, spanned, agreed): the documents that hold a passage of an item.

    ``items``: (item_id, text), an evaluation set (read on the driver).  Its index is sent to the executors in slices of
    at most ``MOST_WORDS`` words, or one item; the documents are read once a slice.
    """
    require(documents, id_col, text_col)
    require(items, "item_id", "text")
    spark = documents.sparkSession
    ready, _ = prepare_items([(int(r["item_id"]), r["text"]) for r in items.select("item_id", "text").filter("item_id is not null").collect()], indexed=False)
    texts = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    slices: list[list[Item]] = [[]]
    for item in ready.values():
        if slices[-1] and sum(len(x.words) for x in slices[-1]) + len(item.words) > MOST_WORDS:
            slices.append([])
        slices[-1].append(item)
    found = [texts.mapInPandas(_aligner(spark.sparkContext.broadcast(build_index(part))), "doc_id bigint, item_id bigint, spanned int, agreed int") for part in slices]
    return reduce(DataFrame.unionByName, found).distinct()


def _aligner(sent: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Cases of the documents of a batch, under the index sent."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        for b in batches:
            split = [words(t) for t in b["text"]]
            chunk = np.cumsum([len(ws) for ws in split]) // AT_ONCE
            rows = []
            for c in np.unique(chunk):
                at = np.flatnonzero(chunk == c)
                rows += [(b["id"].iloc[at[d]], *case) for d, *case in cases(sent.value, [split[k] for k in at], known)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "spanned", "agreed"])

    return align
