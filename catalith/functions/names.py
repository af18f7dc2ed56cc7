"""Names typed by people: splitting into forms and tokens, transcription, and one spelling for sounds written alike.

Plain Python functions for use inside Arrow batches; nothing here depends on Spark.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# Katakana in Hepburn, in the order of the kana table; fixed values.
KANA = {
    "ア": "a", "イ": "i", "ウ": "u", "エ": "e", "オ": "o",
    "カ": "ka", "キ": "ki", "ク": "ku", "ケ": "ke", "コ": "ko",
    "ガ": "ga", "ギ": "gi", "グ": "gu", "ゲ": "ge", "ゴ": "go",
    "サ": "sa", "シ": "shi", "ス": "su", "セ": "se", "ソ": "so",
    "ザ": "za", "ジ": "ji", "ズ": "zu", "ゼ": "ze", "ゾ": "zo",
    "タ": "ta", "チ": "chi", "ツ": "tsu", "テ": "te", "ト": "to",
    "ダ": "da", "ヂ": "ji", "ヅ": "zu", "デ": "de", "ド": "do",
    "ナ": "na", "ニ": "ni", "ヌ": "nu", "ネ": "ne", "ノ": "no",
    "ハ": "ha", "ヒ": "hi", "フ": "fu", "ヘ": "he", "ホ": "ho",
    "バ": "ba", "ビ": "bi", "ブ": "bu", "ベ": "be", "ボ": "bo",
    "パ": "pa", "ピ": "pi", "プ": "pu", "ペ": "pe", "ポ": "po",
    "マ": "ma", "ミ": "mi", "ム": "mu", "メ": "me", "モ": "mo",
    "ヤ": "ya", "ユ": "yu", "ヨ": "yo",
    "ラ": "ra", "リ": "ri", "ル": "ru", "レ": "re", "ロ": "ro",
    "ワ": "wa", "ヰ": "i", "ヱ": "e", "ヲ": "o",
    "ン": "n", "ヴ": "vu",
}
_SMALL_Y, _SMALL_V = {"ャ": "ya", "ュ": "yu", "ョ": "yo"}, {"ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o"}
HONORIFICS = r"(?:[\s\-]*(?:san|kun|sama|sensei|senpai|dono|さん|くん|さま|様|先生|君))$"
PET = r"^(.{2,}?)[\-\s]?(?:pyon|rin|chii|cchi|tchi|chan|tan|nyan|pon|ちゃん)$"
KANJI = re.compile(r"[㐀-鿿\U00020000-\U0003134f々〆ヶ]")
KATAKANA = re.compile(r"[ァ-ヺ]")


def to_katakana(text: str) -> str:
    """Hiragana as katakana."""
    return "".join(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c for c in text)


def romaji(text: str) -> str:
    """Kana in Hepburn; other characters stay."""
    out: list[str] = []
    double = False
    for c in to_katakana(text):
        if c == "ッ":
            double = True
            continue
        if c in _SMALL_Y and out and out[-1].endswith("i"):
            head = out.pop()[:-1]
            out.append(head + (_SMALL_Y[c][1] if head in ("sh", "ch", "j") else _SMALL_Y[c]))
            continue
        if c in _SMALL_V and out:
            out[-1] = out[-1][:-1] + _SMALL_V[c]
            continue
        s = "" if c == "ー" else KANA.get(c, c)
        out.append(s[0] + s if double and s else s)
        double = False
    return "".join(out)


# Spellings of one sound, applied in order to lower-case ASCII; fixed values.
_SOUNDS = [
    (r"sch|sh", "s"), (r"tch|cch|ch", "C"), (r"ts", "t"), (r"[cq]", "k"), (r"C", "c"), (r"ti", "ci"), (r"[tc]y", "c"), (r"sy", "s"), (r"dz|dj", "z"), (r"j(?=i)", "z"), (r"zy|j", "y"),
    (r"f", "h"), (r"l", "r"), (r"v", "b"), (r"m(?=[bp])", "n"), (r"o[uo]|oh(?![aeiou])", "o"), (r"(.)\1+", r"\1"), (r"(?<=[aeiou])y(?![aeiou])", "i"),
]
_COMPILED = [(re.compile(p), r) for p, r in _SOUNDS]
_DIGITS = str.maketrans("01345", "oleas")


@lru_cache(maxsize=65_536)
def sound_key(token: str) -> str:
    """One spelling for all romanisations of a word: case, accents, long vowels, doubled letters, l/r, c/k, si/shi."""
    s = unicodedata.normalize("NFKD", romaji(token))
    s = "".join(c for c in s.lower() if not unicodedata.combining(c))
    if re.search(r"[a-z]", s):
        s = s.translate(_DIGITS)
    s = re.sub(r"[^a-z]", "", s)
    for pattern, sound in _COMPILED:
        s = pattern.sub(sound, s)
    return s


class Form(NamedTuple):
    """One written name: what it is and its tokens in written order."""

    kind: str  # name, initial (its first token), pet, epithet (after "the"), kanji (its characters in order)
    tokens: tuple[str, ...]


def _words(text: str) -> list[str]:
    spaced = re.sub(r"(?<=[a-zß-ÿāīūēō])(?=[A-Z])", " ", text)  # WrittenTogether
    return [w for w in re.split(r"[\s_,;/・=＝·'\"“”!?~*#()\[\]{}<>|\-–]+", spaced) if w]


@lru_cache(maxsize=65_536)
def name_forms(text: str) -> tuple[Form, ...]:
    """The forms one written name stands for; empty for what is no name."""
    t = " ".join(unicodedata.normalize("NFKC", text).split())
    t = re.sub(r"^[\s\"'“”!?.~*]+|[\s\"'“”!?~*]+$", "", t)
    out: list[Form] = []
    for inner in re.findall(r"\(([^()]+)\)", t):  # a reading or another spelling in brackets
        out += name_forms(inner)
    t = re.sub(r"\s*\([^()]*\)?", "", t).strip() or ("" if out else t)
    if not t:
        return tuple(out)
    if KANJI.search(t):
        parts = [p for p in re.split(r"[\s・,、_\-]+", re.sub(HONORIFICS, "", t)) if p]
        return (*out, Form("kanji", ("".join(sorted("".join(parts))),)))
    plain = re.sub(HONORIFICS, "", t, flags=re.IGNORECASE)
    m = re.match(r"(?i)^(?:(.*?)\s+)?the\s+(.+)$", t)
    if m:
        out.append(Form("epithet", tuple(k for w in _words(m[2]) if (k := sound_key(w)))))
        return (*out, *(name_forms(m[1]) if m[1] else ()))
    pet = re.match(PET, plain if plain != t else t, re.IGNORECASE)
    words = _words(plain)
    if pet and len(_words(pet[1])) == 1 and len(words) <= 2:
        return (*out, Form("pet", (sound_key(pet[1]),)))
    initials = [w for w in words if len(w.rstrip(".")) == 1]
    tokens = [k for w in words if len(w.rstrip(".")) > 1 and (k := sound_key(w))]
    if initials and tokens:
        return (*out, Form("initial", (initial_class(initials[0]), *tokens)))
    if tokens:
        out.append(Form("name", tuple(tokens)))
    return tuple(out)


def initial_class(text: str) -> str:
    """First sound of a name, as far as an initial tells it."""
    c = unicodedata.normalize("NFKD", text[:1]).lower()[:1]
    return {"c": "k", "q": "k", "l": "r", "j": "y", "f": "h", "v": "b"}.get(c, c)


def edit_distance(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; more than ``most`` is ``most + 1``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row, last = row, [i], before
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


LONGEST = 64  # letters of a word up to which slips are looked for; longer ones are no words of a language


def deletions(word: str, most: int) -> set[str]:
    """The word and what is left of it without up to ``most`` letters: words within that distance share one of them.

    A word of over LONGEST letters only has itself, since what is left of it grows with the square of its length.
    """
    found = level = {word}
    if len(word) > LONGEST:
        return found
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        found = found | level
    return found
