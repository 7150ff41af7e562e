"""Streams with state for each source: which URLs its boards list, and how many they listed.

State processors need the RocksDB state store (`use_state_store`). A crawl is one row, so that no split of the stream into
batches divides it; the crawls of a batch are taken in the order of their times, and a crawl that isn't younger than the last
one of its source has been seen before and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.maintenance import ALPHA, CLOSE_LEAST, CLOSE_SHARE, DROP, STREAK, WARM_UP

HOUR = 3_600_000_000
#: Days after which a closed URL, or a source without crawls, is forgotten.
FORGET_DAYS = 90


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Presence(StatefulProcessor):
    """State of a source: for each URL (last_seen, missing_since, closed_at) in microseconds, and the time of its last crawl."""

    def __init__(self, gap_hours: float, refresh_hours: float, forget_days: float):
        self.gap, self.refresh, self.forget = gap_hours * HOUR, refresh_hours * HOUR, forget_days * 24 * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.urls = handle.getMapState("urls", "url string", "last_seen long, missing_since long, closed_at long")
        self.last = handle.getValueState("last", "at long")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.urls.updateValue((initialState.url,), (initialState.last_seen, initialState.missing_since, initialState.closed_at))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = {k[0]: tuple(v) for k, v in self.urls.iterator()} if self.urls.exists() else {}
        last = self.last.get()[0] if self.last.exists() else None
        out: list[Row] = []
        for r in sorted(rows, key=lambda r: r.at):
            if last is not None and r.at <= last:
                continue
            last = r.at
            for url, event, state in self.crawl(known, set(r.urls or ()), bool(r.healthy), r.at):
                known[url] = state
                self.urls.updateValue((url,), state)
                out.append(Row(source=key[0], at=r.at, url=url, event=event, last_seen=state[0], missing_since=state[1], closed_at=state[2]))
            for url in [u for u, (_, _, closed) in known.items() if closed is not None and closed < last - self.forget]:
                del known[url]
                self.urls.removeKey((url,))
        if last is not None:
            self.last.update((last,))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int((last + self.forget) // 1000))
        return iter(out)

    def crawl(self, known: dict, listed: set[str], healthy: bool, at: int) -> list[tuple[str, str, tuple]]:
        """(url, what happened, new state) of every URL that a crawl changes."""
        out = []
        for url in sorted(listed):
            seen, missing, closed = known.get(url, (None, None, None))
            if seen is None or seen < at - self.refresh or missing is not None or closed is not None:
                event = "new" if url not in known else "reopened" if closed is not None else "seen"
                out.append((url, event, (at, None, None)))
        if not healthy:
            return out
        gone = [(u, s) for u, s in known.items() if s[2] is None and u not in listed]
        out += [(u, "missed", (s[0], at, None)) for u, s in sorted(gone) if s[1] is None]
        again = sorted((s[1], u, s) for u, s in gone if s[1] is not None and s[1] <= at - self.gap)
        recent = sum(s[2] is not None and s[2] >= at - 24 * HOUR for s in known.values())
        still = sum(s[2] is None for s in known.values())
        room = max(0, max(CLOSE_LEAST, int((still + recent) * CLOSE_SHARE)) - recent)
        return out + [(u, "closed", (s[0], s[1], at)) for _, u, s in again[:room]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.urls.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def presence(crawls: DataFrame, registry: DataFrame | None = None, gap_hours: float = 1, refresh_hours: float = 6, forget_days: float = FORGET_DAYS, late: str = "2 days") -> DataFrame:
    """source, at, url, event (new, seen, missed, closed, reopened), last_seen_at, missing_since, closed_at: what each crawl changes.

    crawls: source, at, healthy, urls (array). registry, where the stream starts from it: source, url, last_seen_at, missing_since, closed_at.
    The rules are those of `maintenance.presence`, crawl by crawl; URLs that aren't known yet are new. Crawls that come later than
    `late` after the latest are left out; a source without crawls for so many days of the stream's time is forgotten by a timer.
    """
    micros = lambda c: F.unix_micros(c).alias(c)
    timed = crawls.where("source IS NOT NULL AND at IS NOT NULL").select("source", F.col("at").alias("time"), micros("at"), "healthy", "urls")
    rows = timed.withWatermark("time", late).groupBy("source")
    start = None
    if registry is not None:
        start = registry.select("source", "url", F.unix_micros("last_seen_at").alias("last_seen"), micros("missing_since"), micros("closed_at")).groupBy("source")
    kind = crawls.schema["source"].dataType.simpleString()
    schema = f"source {kind}, at long, url string, event string, last_seen long, missing_since long, closed_at long"
    out = rows.transformWithState(Presence(gap_hours, refresh_hours, forget_days), schema, "Update", "EventTime", start)
    time = lambda c, name=None: F.timestamp_micros(c).alias(name or c)
    return out.select("source", time("at"), "url", "event", time("last_seen", "last_seen_at"), time("missing_since"), time("closed_at"))


class Coverage(StatefulProcessor):
    """State of a source: samples, baseline, length of the low streak, and when it was flagged."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "samples int, baseline double, low int, flagged string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, base, low, flag = self.state.get() if self.state.exists() else (0, 0.0, 0, None)
        for r in sorted(rows, key=lambda r: r.at):
            if n < WARM_UP:
                base += (r.n - base) / (n + 1)
                low, flag = 0, None
            elif base > 0 and r.n < base * DROP:
                low += 1
                flag = flag or (str(r.at) if low >= STREAK else None)
            else:
                base, low, flag = base + ALPHA * (r.n - base), 0, None
            n += 1
        self.state.update((n, float(base), low, flag))
        yield Row(source=key[0], samples=n, baseline=float(base), low=low, flagged=flag)

    def close(self) -> None:
        pass


def coverage(stream: DataFrame, key: str = "source", at: str = "at", count: str = "n") -> DataFrame:
    """The drop detector over a stream of (source, at, n): a row for each source and batch, with state kept between them."""
    rows = stream.select(F.col(key).alias("source"), F.col(at).alias("at"), F.col(count).alias("n"))
    kind = rows.schema["source"].dataType.simpleString()
    out = rows.groupBy("source").transformWithState(Coverage(), f"source {kind}, samples int, baseline double, low int, flagged string", "Update", "None")
    return out.withColumnRenamed("source", key)
