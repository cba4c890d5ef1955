"""Stateful streams on Spark's state store (T5, T9), with event-time timers.

Rows of a key wait in a list state until the watermark has passed them; a timer then takes
them in order of event time, so results don't depend on how rows are cut into batches. A
batch touches the keys that it has rows or timers of, and no others. What a key keeps is of
fixed size beside the rows that still wait, which are those of the last batch and of the
lateness allowed: limit a batch by the source's options (files or bytes per trigger).

Rows later than the watermark are dropped, as in all of Spark's stateful operators; rows
after the last watermark wait for the next run. State is in RocksDB, so that it needn't fit
in memory. The batch twins are J10, W7, W8, W10 and W11.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows handed to a list state at a time.
CHUNK = 2000


class InOrder(StatefulProcessor):
    """Keeps rows until the watermark has passed them, then hands them to :meth:`step`, the
    earliest first. ``fields`` are their columns after ``at`` (microseconds)."""

    fields, kept = "", ""
    names: tuple[str, ...] = ()

    def row(self, *values) -> Row:
        return Row(*self.names)(*values)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, {self.fields}")
        self.state = handle.getValueState("state", self.kept)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        chunk, first = [], None
        for r in rows:
            chunk.append(self.item(r))
            first = chunk[-1][0] if first is None else min(first, chunk[-1][0])
            if len(chunk) == CHUNK:
                self.waiting.appendList(chunk)
                chunk = []
        if chunk:
            self.waiting.appendList(chunk)
        if first is not None:
            self.call_at(first)
        return iter(())

    def call_at(self, at: int) -> None:
        """A timer for when the watermark has reached a time; it fires after its own."""
        self.handle.registerTimer(-(-at // 1000) - 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for r in self.waiting.get():
            (due if r[0] <= now else later).append(tuple(r))
        if due:
            if later:
                self.waiting.put(later)
                self.call_at(min(r[0] for r in later))
            else:
                self.waiting.clear()
        yield from self.step(key, sorted(due), now)

    def close(self) -> None:
        pass

    def item(self, row: Row) -> tuple:
        raise NotImplementedError

    def step(self, key, due: list[tuple], now: int) -> Iterator[Row]:
        raise NotImplementedError


class CleanRuns(InOrder):
    """T5. At equal times an error comes first, then a start, so that both count before a
    completion."""

    fields, kept = "rank int", "started long"

    def __init__(self, within: int):
        self.within = within

    def item(self, row: Row) -> tuple:
        return row["at"], row["rank"]

    def step(self, key, due: list[tuple], now: int) -> Iterator[Row]:
        started = was = self.state.get()[0] if self.state.exists() else None
        for at, rank in due:
            if rank == 1:
                started = at
            else:
                if rank == 2 and started is not None and at - started <= self.within:
                    yield self.row(*key, started, at)
                started = None
        if started is not None and now - started > self.within:
            started = None  # no completion can come in time
        if started is None and was is not None:
            self.state.clear()
        elif started is not None and started != was:
            self.state.update((started,))
            self.handle.registerTimer((started + self.within) // 1000 + 1)


class Ewma(InOrder):
    """The exponential mean after each row."""

    fields, kept = "seq long, value double", "mean double"

    def __init__(self, lam: float):
        self.lam = lam

    def item(self, row: Row) -> tuple:
        return row["at"], row["seq"], row["value"]

    def step(self, key, due: list[tuple], now: int) -> Iterator[Row]:
        mean = self.state.get()[0] if self.state.exists() else None
        for _, seq, value in due:
            mean = value if mean is None else self.lam * value + (1 - self.lam) * mean
            yield self.row(*key, seq, mean)
        if due:
            self.state.update((mean,))


class Thresholds(Ewma):
    """Quantiles of the last ``n`` values, Page-Hinkley drift, and the first quantile
    as it was before a drift, held for ``freeze`` rows."""

    kept = "seen long, total double, c double, low double, since long, held double, last array<double>"

    def __init__(self, n: int, delta: float, limit: float, freeze: int):
        self.n, self.delta, self.limit, self.freeze = n, delta, limit, freeze

    def step(self, key, due: list[tuple], now: int) -> Iterator[Row]:
        known = self.state.get() if self.state.exists() else (0, 0.0, 0.0, float("inf"), self.freeze + 1, None, [])
        seen, total, c, low, since, held, last = (*known[:6], list(known[6]))
        ordered = sorted(last)
        for _, seq, value in due:
            last.append(value)
            insort(ordered, value)
            if len(last) > self.n:
                del ordered[bisect_left(ordered, last.pop(0))]
            seen, total = seen + 1, total + value
            c += value - total / seen - self.delta
            low = min(low, c)
            drift = c - low > self.limit
            since = 0 if drift else since + 1
            alpha, beta, z = (_quantile(ordered, q) for q in (0.90, 0.95, 0.99))
            held = alpha if since > self.freeze else held
            yield self.row(*key, seq, alpha, beta, z, drift, held)
        if due:
            self.state.update((seen, total, c, low, since, held, last))


def _quantile(ordered: list[float], q: float) -> float:
    place = (len(ordered) - 1) * q
    low = int(place)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (place - low)


def _keyed(events: DataFrame, key: str, columns: list, processor: InOrder, out: str, late: str) -> DataFrame:
    """``events`` (with ``ts``) through a processor; the time in microseconds is ``at``."""
    spark: SparkSession = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("at"), *columns)
    kind = events.schema[key].dataType.simpleString()
    processor.names = (key, *[c.split()[0] for c in out.split(", ")])
    return rows.groupBy(key).transformWithState(processor, f"{key} {kind}, {out}", "Append", "EventTime")


def clean_runs(events: DataFrame, key: str, start: str, done: str, error: str, within: int, late: str = "10 minutes") -> DataFrame:
    """T5: starts that were done within so many microseconds with no error in between:
    ``key, started, ended``. ``events``: ``key, kind, ts``. An open start goes by a timer
    when it can't be done in time any more."""
    rank = F.when(F.col("kind") == error, 0).when(F.col("kind") == start, 1).otherwise(2)
    some = events.filter(F.col("kind").isin(start, done, error) & F.col("ts").isNotNull())
    return _keyed(some, key, [rank.alias("rank")], CleanRuns(within), "started long, ended long", late)


def ewma_stream(events: DataFrame, key: str, lam: float = 0.15, late: str = "10 minutes") -> DataFrame:
    """Exponential mean of each key's ``value`` in order of time and ``seq``:
    ``key, seq, ewma``. Rows without a time or value don't count."""
    some = events.filter("ts IS NOT NULL AND value IS NOT NULL")
    return _keyed(some, key, ["seq", F.col("value").cast("double").alias("value")], Ewma(lam), "seq long, ewma double", late)


def threshold_stream(events: DataFrame, key: str, n: int = 90, delta: float = 1.0, limit: float = 50.0, freeze: int = 20, late: str = "10 minutes") -> DataFrame:
    """q90, q95 and q99 of the last ``n`` values, drift and the value held after it:
    ``key, seq, alpha, beta, z, drift, frozen``. Rows without a time or value don't count."""
    some = events.filter("ts IS NOT NULL AND value IS NOT NULL")
    out = "seq long, alpha double, beta double, z double, drift boolean, frozen double"
    return _keyed(some, key, ["seq", F.col("value").cast("double").alias("value")], Thresholds(n, delta, limit, freeze), out, late)
