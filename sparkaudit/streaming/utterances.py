"""Live utterances with timers: a call that falls silent is closed, one that never does comes in parts.

Each call has a keyed state (``transformWithState``): the fragments that may still be
overtaken by earlier ones, the open part, and where the call stands.  What is older than the call's newest
fragment by ``lateness`` is settled: no order of arrival can change it any more, so parts and cuts
are those of ``transcripts.utterances`` over the finished table.  A processing-time timer
settles and closes a call after ``idle`` without a fragment, so the newest utterance needs no
later event.  A fragment that comes after its place was settled is not dropped: it is a
row of its own, marked ``late``.

State is bounded: ``per_part`` fragments of an open part, ``most`` that wait, and one short row
for a silent call, which goes after ``keep``.  A call that sends more than ``most`` fragments within the
lateness has the older half settled at once.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sparkaudit.operators.transcripts import FRAGMENTS_PER_PART

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PIECE = "ts bigint, text string"
COLUMNS = "start bigint, end bigint, part int, fragments int, text string, final boolean, late boolean"


class UtteranceProcessor(StatefulProcessor):
    """Times of fragments are microseconds."""

    def __init__(self, call: str, gap: timedelta, lateness: timedelta, idle: timedelta, keep: timedelta, per_part: int, most: int):
        self.call = call
        self.gap, self.lateness = (int(d / timedelta(microseconds=1)) for d in (gap, lateness))
        self.idle, self.keep = (int(d / timedelta(milliseconds=1)) for d in (idle, keep))
        self.per_part, self.most = per_part, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PIECE)
        self.open = handle.getListState("open", PIECE)
        # Last settled time, start of the open utterance, its next part; outlives the call for a while to know late fragments.
        self.place = handle.getValueState("place", "last bigint, start bigint, part int", self.keep)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.load(key)
        for row in rows:
            self.held.append((row["ts"], row["text"]))
            if len(self.held) > self.most:
                self.held.sort(key=order)
                yield from self.settle(len(self.held) // 2)
        if self.held:
            self.held.sort(key=order)
            bound = self.held[-1][0] - self.lateness
            yield from self.settle(sum(ts <= bound for ts, _ in self.held))
            if self.last is not None and self.part_open() and bound - self.last >= self.gap:
                yield self.closed()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        self.store()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.load(key)
        self.held.sort(key=order)
        yield from self.settle(len(self.held))
        if self.part_open():
            yield self.closed()
        self.store()

    def close(self) -> None:
        pass

    def load(self, key: tuple) -> None:
        self.key = key[0]
        self.held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        self.pieces = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        self.last, self.start, self.part = self.place.get() if self.place.exists() else (None, None, 0)

    def store(self) -> None:
        for state, rows in ((self.waiting, self.held), (self.open, self.pieces)):
            state.put(rows) if rows else state.clear()
        if self.last is not None:
            self.place.update((self.last, self.start, self.part))

    def part_open(self) -> bool:
        return self.start is not None

    def settle(self, n: int) -> Iterator[Row]:
        """Put the first ``n`` held fragments, in order, where they belong; rows that are complete."""
        now, self.held = self.held[:n], self.held[n:]
        for ts, text in now:
            if self.last is not None and ts < self.last:
                yield self.row(ts, ts, 0, [(ts, text)], True, True)
                continue
            if self.part_open() and ts - self.last >= self.gap:
                yield self.closed()
            if not self.part_open():
                self.start, self.part = ts, 0
            elif len(self.pieces) == self.per_part:
                yield self.row(self.start, self.last, self.part, self.pieces, False, False)
                self.pieces, self.part = [], self.part + 1
            self.pieces.append((ts, text))
            self.last = ts

    def closed(self) -> Row:
        out = self.row(self.start, self.last, self.part, self.pieces, True, False)
        self.pieces, self.start, self.part = [], None, 0
        return out

    def row(self, start, end, part: int, pieces: list, final: bool, late: bool) -> Row:
        text = " ".join(t for _, t in pieces if t is not None)
        values = {"start": start, "end": end, "part": part, "fragments": len(pieces), "text": text, "final": final, "late": late}
        return Row(**{self.call: self.key, **values})


def order(piece: tuple) -> tuple:
    """Order of fragments: time, then text, null first."""
    ts, text = piece
    return ts, text is not None, text or ""


def live_utterances(
    fragments: DataFrame,
    gap: timedelta = timedelta(seconds=2),
    lateness: timedelta = timedelta(seconds=10),
    idle: timedelta = timedelta(seconds=30),
    keep: timedelta = timedelta(days=1),
    per_part: int = FRAGMENTS_PER_PART,
    most: int = 10 * FRAGMENTS_PER_PART,
    call: str = "call_id",
) -> DataFrame:
    """Stream of fragments (call, ts, text) to utterance parts: (call, start, end, part, fragments, text, final, late).

    Rows without a time belong to no utterance.  Run it with a processing-time trigger: its timers need batches without data.
    """
    kind, clock = (fragments.schema[c].dataType.simpleString() for c in (call, "ts"))
    processor = UtteranceProcessor(call, gap, lateness, idle, keep, per_part, most)
    timed = fragments.filter("ts IS NOT NULL").select(call, F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "text")
    out = timed.groupBy(call).transformWithState(processor, f"{call} {kind}, {COLUMNS}", "Append", "ProcessingTime")
    return out.withColumns({c: F.timestamp_micros(c).cast(clock) for c in ("start", "end")})


def start_utterances(fragments: DataFrame, path: str, checkpoint: str, every: str = "1 second", **how) -> StreamingQuery:
    """Write utterance parts as Parquet, each once; the session's state provider is set for this stream alone."""
    conf = fragments.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)
    try:
        writer = live_utterances(fragments, **how).writeStream.format("parquet").option("path", path)
        return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    finally:
        conf.set(PROVIDER, before)


def wait_for_fragments(spark: SparkSession, query: StreamingQuery, path: str, n: int, seconds: float = 600) -> None:
    """Wait until ``n`` fragments are written, and stop the stream; raise if they are not in time."""
    until = time.monotonic() + seconds
    try:
        while time.monotonic() < until:
            time.sleep(0.2)
            if query.exception() is not None:
                raise query.exception()
            if query.lastProgress is None:  # nothing written yet
                continue
            written = spark.read.schema("fragments int").parquet(path).agg({"fragments": "sum"}).first()[0]
            if (written or 0) >= n:
                return
        raise TimeoutError(f"{n} fragments were not written in {seconds} s")
    finally:
        query.stop()
