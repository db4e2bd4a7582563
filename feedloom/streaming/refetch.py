"""Suppress fetching a URL again within 24 hours of its last fetch.

A URL's first request is fetched; after a fetch the next one is the first request that comes
24 hours later or more, so requests in between do not put it off.

The batch form follows this chain without gathering a popular URL's requests:

1. Requests collapse to one row per URL and minute, with the first and the last time. From a
   minute that may hold a fetch, the next fetch lies in the same minute of the next day, or, if
   that may have nothing late enough, in the next minute that has a request. One pass over a
   URL's minutes in order, with a queue of one day, finds all minutes that may hold a fetch.
2. Only the requests in these minutes are read again, and followed exactly. Every fetch is
   among them, and so is every request between the due time and the fetch in its minute.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOURS = 24
PAUSE = HOURS * 3600 * 1_000_000
MINUTE = 60 * 1_000_000
#: Requests that come later than this are not counted in the stream.
DELAY = "1 hour"


def _fetch_minutes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The minutes that may hold a fetch, from rows in the order of URL and minute."""
    url, due, open_end = object(), deque(), False
    for batch in batches:
        urls, minutes = [], []
        for this, minute, first, last in zip(*[batch.column(c).to_pylist() for c in ("url", "minute", "first", "last")], strict=True):
            new = this != url
            if new:
                url, due, open_end = this, deque(), False
            held = new or open_end
            open_end = False
            while due and due[0][0] <= minute:
                at, soonest, latest = due.popleft()
                held = held or at < minute or last >= soonest
                # Due after this minute's last request: the next minute's turn.
                open_end = open_end or (at == minute and last < latest)
            if held:
                urls.append(this)
                minutes.append(minute)
                due.append((minute + PAUSE // MINUTE, first + PAUSE, last + PAUSE))
        yield pa.RecordBatch.from_pydict({"url": pa.array(urls, pa.string()), "minute": pa.array(minutes, pa.int64())})


def _follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fetches, from requests in the order of URL and time."""
    url, free = object(), 0
    for batch in batches:
        urls, times = [], []
        for this, at in zip(batch.column("url").to_pylist(), batch.column("at").to_pylist(), strict=True):
            if this != url or at >= free:
                url, free = this, at + PAUSE
                urls.append(this)
                times.append(at)
        yield pa.RecordBatch.from_pydict({"url": pa.array(urls, pa.string()), "at": pa.array(times, pa.int64())})


def first_requests(requests: DataFrame) -> DataFrame:
    """Batch form: (url, fetch_at) of every fetch among ``requests`` (url, ts).

    Requests without URL or time are no requests. A URL has at most one row a minute in the
    first pass, however popular it is.
    """
    known = requests.filter(F.col("url").isNotNull() & F.col("ts").isNotNull())
    timed = known.select("url", F.unix_micros("ts").alias("at")).withColumn("minute", F.floor(F.col("at") / MINUTE))
    per_minute = timed.groupBy("url", "minute").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    in_order = per_minute.repartition("url").sortWithinPartitions("url", "minute")
    held = in_order.mapInArrow(_fetch_minutes, "url string, minute bigint")
    wanted = timed.join(held, ["url", "minute"], "left_semi").select("url", "at").distinct()
    fetched = wanted.repartition("url").sortWithinPartitions("url", "at").mapInArrow(_follow, "url string, at bigint")
    return fetched.select("url", F.timestamp_micros("at").alias("fetch_at"))


def _fetches(key: tuple[Any, ...], frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One URL's requests of a batch; the state is the time from which it may be fetched again."""
    if state.hasTimedOut:
        state.remove()
        return
    free = state.get[0] if state.exists else None
    times = sorted(set().union(*[set(frame["at"].tolist()) for frame in frames]))
    out = []
    for at in times:
        if free is None or at >= free:
            out.append(at)
            free = at + PAUSE
    state.update((free,))
    state.setTimeoutTimestamp(max(free // 1000, state.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame({"url": key[0], "at": out})


def first_requests_stream(requests: DataFrame, delay: str = DELAY) -> DataFrame:
    """Streaming form of ``first_requests`` for requests that arrive in order, up to ``delay``.

    A URL's state is one time; a timer removes it when the watermark reaches that time, since
    any request is then fetched. A request that arrives after a later one was fetched is
    counted as in between. Inside a batch only the distinct times of a URL are kept.
    """
    known = requests.filter(F.col("url").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay)
    timed = known.select("url", "ts", F.unix_micros("ts").alias("at"))
    fetched = timed.groupBy("url").applyInPandasWithState(
        _fetches, "url string, at bigint", "free bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
    return fetched.select("url", F.timestamp_micros("at").alias("fetch_at"))
