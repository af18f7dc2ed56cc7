"""Air times of many hands, formats and zones, normalised to one unambiguous form.

Every text is turned into the array of all its valid interpretations.  A Viterbi path over the record order of its
source picks one.  A state of the path is an interpretation together with the date order (day or month first) the
source writes in at that record: texts that can only be read one way show the order, and it is carried over records
that do not show it.  A change of that order costs most, a change of format from one record to the next and a jump
back in time cost less.  The order a source declares is a prior and no more: reading a record against it costs
``DECLARED_COST``, which a few records that contradict the declaration outweigh.

The path is exact and distributed: records are range-partitioned by (source, order), every partition reduces each of
its source runs to a small cost matrix between the run's first and last states, the driver joins those matrices (one
per partition and source), and each partition then traces its own part of the path back.  Partitions hold about
``ROWS`` records, however many a source has.

Cases: null, blank or meaningless texts, incomplete dates and dates that do not exist have no interpretation and give
no row.  A local time skipped by a change to summer time gives status ``gap``; one that occurred twice and carries no
offset or zone abbreviation gives ``twice``; both without ``aired_norm``.  A source without a known zone can only give
dates and instants with their own zone (status ``no_zone`` otherwise).  Equal paths take the earlier interpretation.
Repeated rows are kept.  Columns other than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.runtime import cut, require, shuffle_partitions

# Month names as people write them: English, German, French, Italian, Spanish; fixed values.
MONTHS = {
    "january": 1, "jan": 1, "januar": 1, "janvier": 1, "gennaio": 1, "enero": 1,
    "february": 2, "feb": 2, "februar": 2, "février": 2, "fevrier": 2, "febbraio": 2, "febrero": 2,
    "march": 3, "mar": 3, "märz": 3, "maerz": 3, "mars": 3, "marzo": 3,
    "april": 4, "apr": 4, "avril": 4, "aprile": 4, "abril": 4,
    "may": 5, "mai": 5, "maggio": 5, "mayo": 5,
    "june": 6, "jun": 6, "juni": 6, "juin": 6, "giugno": 6, "junio": 6,
    "july": 7, "jul": 7, "juli": 7, "juillet": 7, "luglio": 7, "julio": 7,
    "august": 8, "aug": 8, "août": 8, "aout": 8, "agosto": 8,
    "september": 9, "sep": 9, "sept": 9, "septembre": 9, "settembre": 9, "septiembre": 9,
    "october": 10, "oct": 10, "oktober": 10, "okt": 10, "octobre": 10, "ottobre": 10, "octubre": 10,
    "november": 11, "nov": 11, "novembre": 11, "noviembre": 11,
    "december": 12, "dec": 12, "dezember": 12, "dez": 12, "décembre": 12, "decembre": 12, "dicembre": 12, "diciembre": 12,
}

# Zone abbreviations and their offsets in minutes; fixed values.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "z": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "jst": 540, "kst": 540, "awst": 480, "acst": 570, "acdt": 630, "aest": 600,
    "aedt": 660, "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420,
    "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

# First years of the Japanese eras; fixed values.
ERAS = {"明治": 1868, "大正": 1912, "昭和": 1926, "平成": 1989, "令和": 2019}

WEEKDAY = r"(?:(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)[a-z]*\.?,?\s+)?"
TIME = (
    r"(?:(?P<jm>午前|午後)\s*)?(?P<H>\d{1,2})(?:[:.時h]|\s?h\s?)(?P<M>\d{2})分?(?::(?P<S>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
    r"(?:\s*(?P<ap>[ap]\.?m(?![a-z])\.?))?(?:\s*uhr)?"
)
ZONE = (
    r"(?:\s*(?:(?P<off>(?:(?:utc|gmt)\s?)?[+-]\d{1,2}(?::?\d{2})?)|\(?(?P<abbr>[a-z]{1,5})\)?|"
    r"(?P<iana>[a-z]+(?:/[a-z_+\-]+){1,2})))?(?:\[(?P<brk>[a-z_/+\-]+)\])?"
)
LINK = r"(?:\s*(?:t|,|\bat\b|\bà\b|\bore\b|\bum\b|\balle\b|\ba las\b|\s)\s*|(?<=[日)])\s*)"
TAIL = rf"(?:{LINK}{TIME}{ZONE})?\s*$"


def _shape(date: str) -> re.Pattern[str]:
    return re.compile(rf"^{WEEKDAY}{date}(?:\s*\([月火水木金土日]\))?{TAIL}", re.IGNORECASE)


NAME = r"(?P<n>[^\W\d_]{3,10})"
SHAPES = [
    ("ymd", _shape(r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})")),
    ("numeric", _shape(r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{4})")),
    ("named_dmy", _shape(rf"(?P<d>\d{{1,2}})(?:st|nd|rd|th|er|º|\.)?[\s\-]*(?:de\s+)?{NAME}\.?[\s\-]*(?:de\s+)?(?P<y>\d{{4}})")),
    ("named_mdy", _shape(rf"{NAME}\.?[\s\-]*(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?[\s\-]*(?P<y>\d{{4}})")),
    ("cjk", _shape(r"(?P<y>\d{4})年\s*(?P<m>\d{1,2})月\s*(?P<d>\d{1,2})日")),
    ("era", _shape(r"(?P<era>明治|大正|昭和|平成|令和)(?P<ey>\d{1,2}|元)年\s*(?P<m>\d{1,2})月\s*(?P<d>\d{1,2})日")),
    ("iso_week", _shape(r"(?P<y>\d{4})-?w(?P<w>\d{2})-?(?P<wd>[1-7])")),
    ("compact", re.compile(r"^(?P<c>\d{8})(?:t(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})?(?:[.,](?P<f>\d{1,9}))?(?P<off>z|[+-]\d{2}:?\d{2})?)?$", re.IGNORECASE)),
    ("epoch_s", re.compile(r"^(?P<e>-?\d{9,10})(?:\.\d+)?$")),
    ("epoch_ms", re.compile(r"^(?P<e>\d{12,13})$")),
]
EPOCH_RANGE = (-315_619_200, 4_102_444_800)  # seconds: the years 1960 to 2100, in which a bare number may be an epoch
LATE_NIGHT = 30  # broadcast clocks run on to 29:59
SWITCH_COST = 3.0  # for changing the date order from one record to the next
DECLARED_COST = 1.0  # for reading a record against the source's declared date order
ROWS = 200_000  # records of a partition, about
FORMAT_COST = 1.0  # for changing the format from one record to the next
BACKWARD_COST = 1.0  # for a jump back in time of more than BACKWARD_DAYS
BACKWARD_DAYS = 1

#: format, cost, sort instant in epoch milliseconds, normal form or None, status
Interpretation = tuple[str, float, int, str | None, str]
CANDIDATES = "array<struct<fmt:string,cost:double,at:bigint,norm:string,status:string>>"
EPOCH = dt.datetime(1970, 1, 1)


@lru_cache(maxsize=4096)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _iso(ms: int) -> str:
    t = EPOCH + dt.timedelta(milliseconds=ms)
    return f"{t.year:04d}-{t.month:02d}-{t.day:02d}T{t.hour:02d}:{t.minute:02d}:{t.second:02d}.{t.microsecond // 1000:03d}Z"


def _millis(t: dt.datetime) -> int:
    return (t - EPOCH) // dt.timedelta(milliseconds=1)


def _dates(kind: str, g: dict[str, str | None], order: str | None) -> list[tuple[str, float, dt.date]]:
    """All readings of the date part that exist in the calendar, with the cost of each."""
    out: list[tuple[str, float, dt.date]] = []

    def add(fmt: str, cost: float, y: int, m: int, d: int) -> None:
        try:
            out.append((fmt, cost, dt.date(y, m, d)))
        except ValueError:
            pass

    def cost(fmt: str) -> float:
        return 0.0 if order in (None, fmt) else DECLARED_COST

    if kind in ("ymd", "cjk"):
        add(kind, 0.0, int(g["y"]), int(g["m"]), int(g["d"]))
    elif kind == "numeric":
        a, b, y = int(g["a"]), int(g["b"]), int(g["y"])
        if order == "ymd":  # the declared order says nothing about a date that ends with the year
            order = None
        add("dmy", cost("dmy"), y, b, a)
        if a != b:
            add("mdy", cost("mdy"), y, a, b)
    elif kind in ("named_dmy", "named_mdy"):
        month = MONTHS.get(g["n"].lower())
        if month:
            add(kind, 0.0, int(g["y"]), month, int(g["d"]))
    elif kind == "era":
        year = ERAS[g["era"]] + (1 if g["ey"] == "元" else int(g["ey"])) - 1
        add(kind, 0.0, year, int(g["m"]), int(g["d"]))
    elif kind == "iso_week":
        try:
            out.append((kind, 0.0, dt.date.fromisocalendar(int(g["y"]), int(g["w"]), int(g["wd"]))))
        except ValueError:
            pass
    elif kind == "compact":
        c = g["c"]
        if "1900" <= c[:4] <= "2199":
            add("compact_ymd", 0.0, int(c[:4]), int(c[4:6]), int(c[6:]))
        if "1900" <= c[4:] <= "2199":
            add("compact_dmy", max(cost("dmy"), FORMAT_COST), int(c[4:]), int(c[2:4]), int(c[:2]))
            if c[:2] != c[2:4]:
                add("compact_mdy", max(cost("mdy"), FORMAT_COST), int(c[4:]), int(c[:2]), int(c[2:4]))
    return out


def _clock(g: dict[str, str | None], japanese: bool) -> dt.timedelta | None:
    """The time of day, which may run past midnight; None where it is no time."""
    h, m, s = int(g["H"]), int(g["M"]), int(g.get("S") or 0)
    half = (g.get("ap") or "").lower().replace(".", "") or {"午前": "am", "午後": "pm"}.get(g.get("jm") or "", "")
    if half:
        if h > 12:
            return None
        h = h % 12 + (12 if half == "pm" else 0)
    if m > 59 or s > 60 or h > (LATE_NIGHT if japanese else 24) or (h == 24 and not japanese and (m or s)):
        return None
    return dt.timedelta(hours=h, minutes=m, seconds=s, milliseconds=int((g.get("f") or "0").ljust(3, "0")[:3]))


def _offset(text: str) -> int | None:
    """Minutes of a written offset such as +09:00, -5 or UTC+9."""
    m = re.match(r"(?:utc|gmt)?\s?([+-])(\d{1,2}):?(\d{2})?$", text, re.IGNORECASE)
    if not m or int(m[2]) > 14 or int(m[3] or 0) > 59:
        return None
    return (int(m[2]) * 60 + int(m[3] or 0)) * (-1 if m[1] == "-" else 1)


def _instant(local: dt.datetime, g: dict[str, str | None], zone: str | None) -> tuple[int, str | None, str] | None:
    """Sort instant, normal form and status of a local time; None where its zone can't be read."""
    minutes: int | None = None
    if g.get("off"):
        minutes = 0 if g["off"].lower() == "z" else _offset(g["off"])
        if minutes is None:
            return None
    elif g.get("abbr"):
        minutes = ABBREVIATIONS.get(g["abbr"].lower())
        if minutes is None:
            return None
    if minutes is not None:
        ms = _millis(local - dt.timedelta(minutes=minutes))
        return ms, _iso(ms), "ok"
    name = g.get("iana") or g.get("brk") or zone
    z = _zone("/".join(p if p == "UTC" else "_".join(w.capitalize() for w in p.split("_")) for p in name.split("/")) if name and name != zone else name) if name else None
    if z is None:
        return _millis(local), None, "no_zone"
    first, second = local.replace(tzinfo=z, fold=0).utcoffset(), local.replace(tzinfo=z, fold=1).utcoffset()
    ms = _millis(local - first)
    if first != second:
        return ms, None, "twice" if first > second else "gap"
    return ms, _iso(ms), "ok"


def interpretations(text: str | None, zone: str | None, order: str | None) -> list[Interpretation]:
    """All valid interpretations of one air text; the cheapest first, then in the order tried."""
    if text is None:
        return []
    t = " ".join(unicodedata.normalize("NFKC", text).split())
    if not t or not any(c.isdigit() for c in t):
        return []
    out: list[Interpretation] = []
    for kind, pattern in SHAPES:
        m = pattern.match(t)
        if not m:
            continue
        g = m.groupdict()
        if kind.startswith("epoch"):
            ms = int(g["e"]) * (1000 if kind == "epoch_s" else 1)
            if EPOCH_RANGE[0] * 1000 <= ms <= EPOCH_RANGE[1] * 1000:
                out.append((kind, 0.0, ms, _iso(ms), "ok"))
            continue
        for fmt, cost, day in _dates(kind, g, order):
            if not g.get("H"):
                out.append((fmt, cost, _millis(dt.datetime.combine(day, dt.time())), day.isoformat(), "ok"))
                continue
            clock = _clock(g, zone == "Asia/Tokyo" or "時" in t)
            try:
                found = clock is not None and _instant(dt.datetime.combine(day, dt.time()) + clock, g, zone)
            except (OverflowError, ValueError):
                found = None
            if found:
                out.append((fmt, cost, *found))
    return sorted(out, key=lambda c: c[1])


#: position of the interpretation, date order, format, instant, cost
State = tuple[int, str, str, int, float]
DATE_ORDERS = {"dmy": "dmy", "mdy": "mdy", "compact_dmy": "dmy", "compact_mdy": "mdy"}  # the order a format shows


def states(candidates: list[dict]) -> list[State]:
    """The interpretations of a record, each under every date order its source may be writing in."""
    out: list[State] = []
    for k, c in enumerate(candidates):
        shown = DATE_ORDERS.get(c["fmt"])
        out += [(k, order, c["fmt"], int(c["at"]), float(c["cost"])) for order in ((shown,) if shown else ("dmy", "mdy"))]
    return out


def step_cost(a: State, b: State) -> float:
    """Cost of going from one record's state to the next one's."""
    return SWITCH_COST * (a[1] != b[1]) + FORMAT_COST * (a[2] != b[2]) + BACKWARD_COST * (b[3] < a[3] - BACKWARD_DAYS * 86_400_000)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, Iterator[pd.Series]]]:
    """The rows of a sorted partition by source, without holding more than a batch."""
    import itertools

    rows = (r for b in batches for r in b.itertuples(index=False))
    key = lambda r: None if pd.isna(r.source) else r.source
    yield from itertools.groupby(rows, key)


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each source run of the partition: its first and last states and the least costs between them."""
    out = []
    for source, run in _runs(batches):
        first = last = cost = block = None
        for r in run:
            now = states(r.candidates)
            if first is None:
                block, first, cost = r.block, now, [[s[4] if i == j else float("inf") for j, s in enumerate(now)] for i in range(len(now))]
            else:
                steps = [[step_cost(a, b) + b[4] for b in now] for a in last]
                cost = [[min([x + step[j] for x, step in zip(row, steps)]) for j in range(len(now))] for row in cost]
            last = now
        out.append({"source": source, "block": block, "first": [s[:4] for s in first], "last": [s[:4] for s in last], "cost": cost})
    yield pd.DataFrame(out, columns=["source", "block", "first", "last", "cost"])


def _stitch(summaries: list) -> dict[tuple[object, int], tuple[int, int]]:
    """Of each block and source: the interpretations at which the best path enters and leaves."""
    ends: dict[tuple[object, int], tuple[int, int]] = {}
    by: dict[object, list] = {}
    for s in sorted(summaries, key=lambda s: s["block"]):
        by.setdefault(s["source"], []).append(s)
    for source, blocks in by.items():
        total: list[float] = []
        trace = []
        for i, s in enumerate(blocks):
            n = len(s["first"])
            if i == 0:
                enter = [(0.0, -1)] * n
            else:
                before = blocks[i - 1]["last"]
                enter = [min((total[k] + step_cost(before[k], s["first"][j]), k) for k in range(len(before))) for j in range(n)]
            leave = [min((enter[j][0] + s["cost"][j][k], j) for j in range(n)) for k in range(len(s["last"]))]
            trace.append(([e[1] for e in enter], [x[1] for x in leave]))
            total = [x[0] for x in leave]
        k = min(range(len(total)), key=lambda k: (total[k], k))
        for i in range(len(blocks) - 1, -1, -1):
            j = trace[i][1][k]
            ends[source, blocks[i]["block"]] = (j, k)
            k = trace[i][0][j]
    return ends


def best_path(rows: list[list[State]], start: int | None = None, end: int | None = None) -> list[int]:
    """Viterbi over the states of consecutive records, optionally from and to given ones."""
    if not rows:
        return []
    total = [s[4] if start in (None, j) else float("inf") for j, s in enumerate(rows[0])]
    back: list[list[int]] = []
    for a, b in zip(rows, rows[1:]):
        best = [min([(t + step_cost(x, y), k) for k, (t, x) in enumerate(zip(total, a))]) for y in b]
        back.append([k for _, k in best])
        total = [t + y[4] for (t, _), y in zip(best, b)]
    k = min(range(len(total)), key=lambda k: (total[k], k)) if end is None else end
    path = [k]
    for step in reversed(back):
        k = step[k]
        path.append(k)
    return path[::-1]


STATES = "array<struct<k:int,date_order:string,fmt:string,at:bigint>>"
OUT = "id bigint, source string, text string, fmt string, aired_norm string, status string, n_interpretations int"


def normalise_timestamps(
    records: DataFrame,
    sources: DataFrame,
    id_col: str = "row_id",
    source_col: str = "feed_id",
    order_col: str = "fetched_at",
    text_cols: tuple[str, ...] = ("aired_raw", "release_date"),
    zone_col: str = "zone_name",
    date_order_col: str = "date_order",
) -> DataFrame:
    """One row per record that has an interpretation: id, source, text, fmt, aired_norm, status, n_interpretations.

    ``sources`` is a small dimension (one row per source); Spark broadcasts it by its own size check.  The first of
    ``text_cols`` with an interpretation counts.
    """
    require(records, id_col, source_col, order_col, *text_cols)
    parts = max(shuffle_partitions(records.sparkSession), math.ceil(records.count() / ROWS))
    wanted = records.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(source_col).alias("source"), F.col(order_col).alias("at"), F.array(*[F.col(c) for c in text_cols]).alias("texts")
    )
    side = sources.select(F.col(source_col).alias("source"), F.col(zone_col).alias("zone"), F.col(date_order_col).alias("date_order")).dropDuplicates(["source"])
    ranged = (
        wanted.filter(F.exists("texts", lambda t: F.length(F.trim(t)) > 0))
        .join(side, "source", "left")
        .repartitionByRange(parts, "source", "at", "id")
        .sortWithinPartitions("source", "at", "id")
        .select(F.col("source").cast("string").alias("source"), "id", "texts", "zone", "date_order", F.spark_partition_id().alias("block"))
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                zone, order = (x if isinstance(x, str) else None for x in (r.zone, r.date_order))
                for text in r.texts:
                    if found := interpretations(text, zone, order):
                        rows.append((r.source, r.id, text, r.block, [dict(zip(("fmt", "cost", "at", "norm", "status"), c)) for c in found]))
                        break
            yield pd.DataFrame(rows, columns=["source", "id", "text", "block", "candidates"])

    read = cut(ranged.mapInPandas(parse, f"source string, id bigint, text string, block int, candidates {CANDIDATES}"))
    # One small row per partition and source comes to the driver, however many records there are.
    ends = _stitch(
        [
            {"source": r.source, "block": r.block, "first": [tuple(s) for s in r.first], "last": [tuple(s) for s in r.last], "cost": r.cost}
            for r in read.select("source", "block", "candidates")
            .mapInPandas(_summaries, f"source string, block int, first {STATES}, last {STATES}, cost array<array<double>>")
            .collect()
        ]
    )

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for source, run in _runs(batches):
            rows = list(run)
            start, end = ends[source, rows[0].block]
            choices = [states(r.candidates) for r in rows]
            chosen = [r.candidates[s[k][0]] for r, s, k in zip(rows, choices, best_path(choices, start, end))]
            yield pd.DataFrame(
                {
                    "id": [r.id for r in rows],
                    "source": [source] * len(rows),
                    "text": [r.text for r in rows],
                    "fmt": [c["fmt"] for c in chosen],
                    "aired_norm": [c["norm"] for c in chosen],
                    "status": [c["status"] for c in chosen],
                    "n_interpretations": [len(r.candidates) for r in rows],
                }
            )

    return read.mapInPandas(trace, OUT)
