"""Dates and times of catalogue records as Column expressions; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_ABBREVIATIONS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _iso_form(text: Column) -> Column:
    """DD.MM.YYYY turned round."""
    return F.when(text.rlike(r"^[^.]*\.[^.]*\.[^.]*$") & (F.length(text) == 10), F.concat_ws("-", F.split(text, r"\.")[2], F.split(text, r"\.")[1], F.split(text, r"\.")[0])).otherwise(text)


def parse_date(text: Column) -> Column:
    """Instant of a date text; a date alone and any midnight, whatever its offset, is midnight in Japan. Null if invalid."""
    iso = F.regexp_replace(_iso_form(text), "Z", "+00:00")
    midnight = (F.length(iso) == 10) | iso.contains("T00:00:00")
    whole = F.when(midnight, F.concat(F.substring(iso, 1, 10), F.lit("T00:00:00+09:00"))).otherwise(iso)
    return F.when(F.length(text) > 0, F.try_to_timestamp(whole))


def epoch_instant(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def airing_status(start: Column, end: Column, now: Column) -> Column:
    begun, ended = parse_date(start), parse_date(end)
    return F.when(begun.isNull(), "UNKNOWN").when(begun > now, "UPCOMING").when(ended <= now, "FINISHED").otherwise("ONGOING")


def _part(text: Column, at_dash: int, at_dot: int) -> Column:
    return F.when(text.contains("-"), F.get(F.split(text, "-"), F.lit(at_dash))).when(text.contains("."), F.get(F.split(text, r"\."), F.lit(at_dot)))


def season_of(text: Column) -> Column:
    """Season by the month as written, before any shift of zone."""
    month = F.trim(_part(text, 1, 1)).try_cast("int")
    return F.when(month.between(1, 12), F.element_at(F.array(*[F.lit(s) for s in ("WINTER", "SPRING", "SUMMER", "FALL")]), (F.floor((month % 12) / 3) + 1).cast("int")))


def year_of(text: Column) -> Column:
    year = F.coalesce(F.when(text.contains("-"), F.get(F.split(text, "-"), F.lit(0))), F.when(text.contains("."), F.substring(F.get(F.split(text, r"\."), F.lit(2)), 1, 4)))
    return F.when(year.try_cast("int") > 0, year.try_cast("int"))


def offset_time_to_utc(text: Column) -> Column:
    """`2024-01-01T00:30:00+09:00` as `2023-12-31T15:30:00Z`; what can't be read stays."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss'Z'"), text)


def iso_date(text: Column) -> Column:
    """`Oct 20, 1999`, `20. Oct 1999`, ISO or a year, as ISO."""
    month = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
    mdy, dmy = rf"^{month} (\d{{1,2}}), (\d{{4}})$", rf"^(\d{{1,2}})\. {month} (\d{{4}})$"
    number = lambda name: F.array_position(F.array(*[F.lit(m) for m in MONTH_ABBREVIATIONS]), name)
    made = lambda y, m, d: F.date_format(F.try_to_date(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0"))), "yyyy-MM-dd")
    t, g = F.trim(text), F.regexp_extract
    return (
        F.when(t.rlike(mdy), made(g(t, mdy, 3), number(g(t, mdy, 1)), g(t, mdy, 2)))
        .when(t.rlike(dmy), made(g(t, dmy, 3), number(g(t, dmy, 2)), g(t, dmy, 1)))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
        .when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01")))
    )


def broadcast_parts(text: Column) -> Column:
    """Day, time and zone of `Sundays at 23:15 (JST)` or `Sunday 23:15 (JST)`."""
    pattern = r"^\s*(\w+)\s+(?:at\s+)?(\d{1,2}:\d{2})(?:\s*\((\w+)\))?"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return F.struct(part(1).alias("day"), part(2).alias("time"), part(3).alias("zone"))


def aired_range(text: Column) -> Column:
    """Both ends of `A to B`; `?` is none."""
    side = lambda i: F.nullif(F.nullif(F.trim(F.get(F.split(text, " to ", 2), F.lit(i))), F.lit("?")), F.lit(""))
    return F.struct(side(0).alias("start"), side(1).alias("end"))


def premiered(text: Column) -> Column:
    pattern = r"(?i)^\s*(winter|spring|summer|fall)\s+(\d{4})"
    return F.struct(F.nullif(F.lower(F.regexp_extract(text, pattern, 1)), F.lit("")).alias("season"), F.regexp_extract(text, pattern, 2).try_cast("int").alias("year"))


def duration_seconds(text: Column) -> Column:
    """`1 hr. 30 min.`, `24 min per ep` or `01:30:00` in seconds; zero is none."""
    n = lambda p: F.coalesce(F.regexp_extract(text, p, 1).try_cast("int"), F.lit(0))
    clock = r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$"
    c = lambda i: F.coalesce(F.regexp_extract(text, clock, i).try_cast("int"), F.lit(0))
    spoken = n(r"(\d+)\s*(?:hr|hour|h\b)") * 3600 + n(r"(\d+)\s*(?:min|m\b)") * 60 + n(r"(\d+)\s*(?:sec|s\b)")
    return F.nullif(F.when(text.rlike(clock), c(1) * 3600 + c(2) * 60 + c(3)).otherwise(spoken), F.lit(0))


def runtime_seconds(text: Column) -> Column:
    """Minutes at the start of a runtime text, in seconds."""
    return F.regexp_extract(text, r"(\d+)\s*(?:min|$|\s)", 1).try_cast("int") * 60


def fuzzy_date(year: Column, month: Column, day: Column) -> Column:
    """Y, Y-M or Y-M-D as far as known."""
    return F.when(
        year.isNotNull(),
        F.concat_ws("-", F.format_string("%04d", year), F.when(month.isNotNull(), F.format_string("%02d", month)), F.when(month.isNotNull() & day.isNotNull(), F.format_string("%02d", day))),
    )
