"""Stateful and temporal operators: rolling limits, back-off, circuit breaker, expiring cache, windows over events."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# What marks an error as passing; fixed values.
TRANSIENT_CODES = (408, 425, 429, 500, 502, 503, 504, 599)
TRANSIENT_WORDS = ("timeout", "timed out", "connection", "temporarily", "unavailable")


def within_rate(events: DataFrame, key: str, ts: str, most: int, seconds: int = 60, stretch: int = 86_400) -> DataFrame:
    """Events with the number of their key's events in the window up to them, and whether the limit allows them.

    Windows run within stretches of time, so a key of any number of rows is split; events at the end of one stretch are
    seen by the next one too.
    """
    size = max(stretch, seconds) * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own = F.floor(at / size)
    seen = F.when((own + 1) * size - at <= seconds * 1_000_000, F.array(own, own + 1)).otherwise(F.array(own))
    parts = events.withColumns({"_at": at, "_own": own}).withColumn("_part", F.explode(seen))
    window = Window.partitionBy(key, "_part").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    counted = parts.withColumn("in_window", F.count("*").over(window)).filter(F.col("_part").eqNullSafe(F.col("_own")))
    return counted.drop("_at", "_own", "_part").withColumn("allowed", F.col("in_window") <= most)


def backoff_seconds(failures: Column, base: float = 2.0, most: float = 60.0, retry: bool = False) -> Column:
    """Delay doubling with each failure up to eightfold, half as much again on a retry."""
    delay = F.least(F.lit(base) * F.least(F.pow(F.lit(2.0), failures), F.lit(8.0)), F.lit(most))
    return delay * 1.5 if retry else delay


def is_transient(code: Column, message: Column) -> Column:
    words = F.lit(False)
    for w in TRANSIENT_WORDS:
        words = words | F.lower(message).contains(w)
    return F.coalesce(code.isin(*TRANSIENT_CODES), F.lit(False)) | F.coalesce(words, F.lit(False))


def with_retry(action: Callable[[], Any], retries: int = 3, delay: float = 1.0, transient: Callable[[Exception], bool] = lambda _: True, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Run an action on the driver (a sink, say), again after growing delays while it fails for a passing reason."""
    for attempt in range(retries + 1):
        try:
            return action()
        except Exception as e:
            if attempt == retries or not transient(e):
                raise
            sleep(delay * 2**attempt)


def breaker_step(state: str, failures: int, opened: float, ok: bool, now: float, threshold: int, timeout: float) -> tuple[str, int, float]:
    """Next state of a circuit breaker after one outcome."""
    if state == "OPEN" and now - opened >= timeout:
        state = "HALF_OPEN"
    if ok:
        return ("CLOSED", 0, 0.0) if state != "OPEN" else (state, failures, opened)
    failures += 1
    if state == "HALF_OPEN" or failures >= threshold:
        return "OPEN", failures, now
    return state, failures, opened


def circuit_breaker(outcomes: DataFrame, threshold: int = 5, timeout: float = 60.0) -> DataFrame:
    """(service, ts, ok, state) of a stream or table of (service, ts double, ok boolean), by service in order of time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now_state, failures, opened = state.get if state.exists else ("CLOSED", 0, 0.0)
        rows = []
        for r in pd.concat(list(batches)).sort_values("ts").itertuples():
            now_state, failures, opened = breaker_step(now_state, failures, opened, bool(r.ok), float(r.ts), threshold, timeout)
            rows.append((key[0], float(r.ts), bool(r.ok), now_state))
        state.update((now_state, failures, opened))
        yield pd.DataFrame(rows, columns=["service", "ts", "ok", "state"])

    return outcomes.groupBy("service").applyInPandasWithState(run, "service string, ts double, ok boolean, state string", "state string, failures int, opened double", "append", GroupStateTimeout.NoTimeout)


def cache_get(keys: DataFrame, cache: DataFrame, now: Column, key: str = "key") -> DataFrame:
    """All keys with the cached value where it has not expired."""
    live = cache.filter(F.col("expires") > now).select(key, "value")
    return keys.join(live, key, "left").withColumn("hit", F.col("value").isNotNull())


def cache_put(cache: DataFrame, entries: DataFrame, now: Column, ttl_seconds: int, key: str = "key", position: str | None = None) -> DataFrame:
    """The cache with new entries; null values are returned to callers but not kept.

    Of several entries of a key the last by ``position`` stands; without one, the greatest value.
    """
    kept = entries.filter(F.col("value").isNotNull())
    value = F.max_by("value", position) if position else F.max("value")
    new = kept.groupBy(key).agg(value.alias("value")).withColumn("expires", now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds)))
    return cache.join(new.select(key), key, "left_anti").unionByName(new)


def cacheable(responses: DataFrame, status: str = "status_code") -> DataFrame:
    """Responses that may be kept: no errors, nothing without a status."""
    return responses.filter(F.col(status) < 400)


def cache_sweep(cache: DataFrame, now: Column) -> DataFrame:
    return cache.filter(F.col("expires") > now)


def lowest_free_id(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The least positive number that is no id: the first gap."""
    used = ids.filter(F.col(id_col) > 0).select(F.col(id_col).alias("id")).distinct()
    free = used.select((F.col("id") + 1).alias("id")).unionByName(ids.sparkSession.range(1, 2).select(F.col("id").cast(ids.schema[id_col].dataType))).join(used, "id", "left_anti")
    return free.agg(F.min("id").alias("free_id"))


def windowed_counts(events: DataFrame, ts: str, value: str, width: str, slide: str | None = None, late: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling or sliding windows over events; with ``late`` a watermark lets a stream drop what comes later."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    stamped = stamped.withWatermark(ts, late) if late else stamped
    return stamped.groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(events: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    grouped = stamped.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
