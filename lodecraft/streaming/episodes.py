"""Episodes kept as keyed state of a stream: events are folded as they come, in their order, and an episode that falls silent is cancelled."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.traces import STEPS

EPISODE = "trace_id long, steps long, tool_calls long, invalid_actions long, python_seconds double, reason string, events long, closed boolean"
#: The state of a bundle: when its timer expires, and as JSON its open episodes with what waits.
BUNDLED = "timer long, episodes string"
_OUT = Row(*[c.split()[0] for c in EPISODE.split(", ")])
#: 64 neighbouring ids (1 << BUNDLE) share a key: a call to the state costs much more than folding an event.
BUNDLE = 6


class Limits(NamedTuple):
    steps: int
    tools: int
    seconds: float


class Folded(NamedTuple):
    """What an episode has used so far; ``next``: the sequence number that the next event should have."""

    steps: int = 0
    tool_calls: int = 0
    invalid_actions: int = 0
    python_seconds: float = 0.0
    reason: str | None = None
    events: int = 0
    next: int = 0

    def advance(self, sequence: int, kind: str, seconds: float | None, limits: Limits) -> Folded:
        """After one event: the fold of ``operators.traces.episodes``."""
        seen = self._replace(events=self.events + 1, next=sequence + 1)
        if self.reason is not None:
            return seen
        refused = kind == "tool_call" and self.tool_calls >= limits.tools
        steps = self.steps + (kind in STEPS)
        spent = round(self.python_seconds + (seconds or 0.0), 6) if kind == "tool_result" else self.python_seconds
        reason = None
        if kind in ("final", "termination"):
            reason = "final" if kind == "final" else "cancelled"
        elif kind in STEPS or kind == "tool_result":
            reason = "max_steps" if steps >= limits.steps else "python_time_budget" if spent > 0 and spent >= limits.seconds else None
        return seen._replace(steps=steps, tool_calls=self.tool_calls + (kind == "tool_call" and not refused), invalid_actions=self.invalid_actions + (kind == "invalid_action" or refused), python_seconds=spent, reason=reason)


class _Episodes(StatefulProcessor):
    """The open episodes of a bundle of neighbouring ids. One timer: the time at which the first of them falls silent, or an earlier one."""

    def __init__(self, limits: Limits, silence_ms: int):
        self.limits, self.silence_ms = limits, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bundle = handle.getValueState("bundle", BUNDLED)

    def _row(self, trace_id: int, f: Folded, closed: bool) -> Row:
        return _OUT(trace_id, f.steps, f.tool_calls, f.invalid_actions, f.python_seconds, f.reason, f.events, closed)

    def _state(self) -> tuple[dict[int, Folded], dict[int, int], dict[int, dict[int, tuple]], int | None]:
        """What each open episode has used, when it is due to close, its events that wait; and the timer. One call reads it all."""
        folded, due, waiting, timer = {}, {}, {}, None
        if (kept := self.bundle.get()) is not None:
            timer = kept[0]
            for trace_id, at, used, events in json.loads(kept[1]):
                folded[trace_id], due[trace_id], waiting[trace_id] = Folded(*used), at, {event[0]: tuple(event) for event in events}
        return folded, due, waiting, timer

    def _keep(self, folded: dict[int, Folded], due: dict[int, int], waiting: dict[int, dict[int, tuple]], timer: int | None) -> None:
        if folded:
            self.bundle.update((timer, json.dumps([(k, due[k], f, sorted(waiting[k].values())) for k, f in folded.items()])))
        else:
            self.bundle.clear()

    def _all(self, folded: Folded, waiting: dict[int, tuple]) -> Folded:
        for event in sorted(waiting.values()):
            folded = folded.advance(*event, self.limits)
        return folded

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        folded, due, waiting, timer = self._state()
        seen = set()
        for k, sequence, kind, seconds, ts, *_ in rows:
            seen.add(k)
            own = waiting.setdefault(k, {})
            due[k] = max(due.get(k, 0), int(ts.timestamp() * 1000) + self.silence_ms)
            if sequence >= folded.setdefault(k, Folded()).next:  # else it was folded before
                own[sequence] = (sequence, kind, seconds)
        for k in seen:
            f, own = folded[k], waiting[k]
            while f.next in own:
                f = f.advance(*own.pop(f.next), self.limits)
            folded[k] = f
        first = min(due.values())
        if timer is None or first < timer:  # one that has become too early is set again when it expires
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        self._keep(folded, due, waiting, timer)
        for k in seen:  # as it stands if what is missing never comes
            yield self._row(k, self._all(folded[k], waiting[k]), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        folded, due, waiting, _ = self._state()
        expired, watermark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        closed = {k: (folded.pop(k), waiting.pop(k)) for k, at in due.items() if at <= expired or at < watermark}
        timer = min((due[k] for k in folded), default=None)
        self._keep(folded, due, waiting, timer)
        if folded:
            self.handle.registerTimer(timer)
        for k, (f, own) in closed.items():
            f = self._all(f, own)
            yield self._row(k, f._replace(reason=f.reason or "cancelled"), True)

    def close(self) -> None:
        pass


def episodes(events: DataFrame, max_steps: int, max_tools: int, max_seconds: float, late: str = "1 hour", silence_ms: int = 3_600_000, bundle: int = BUNDLE) -> DataFrame:
    """A row (``EPISODE``) of each episode that got events in a micro-batch, as it stands, and a closed one when it ends; for update mode.

    ``events``: a stream of (trace_id, sequence, kind, seconds, ts timestamp). An event is folded when all before it have been; until then it waits in the state, which
    holds a few numbers and these events for each open episode; up to 1 << ``bundle`` episodes of neighbouring ids are one key (more where a micro-batch brings many of them). Rows count what waits as if nothing between were to come, so
    the last row of a trace is that of the batch fold over the same events, however the stream is cut into batches and in whatever order events come.
    Once the watermark (``late``) is ``silence_ms`` beyond an episode's last event, it is closed: what waits is folded, an episode without an end is ``cancelled``, and its
    state goes. Repeated events are folded once. The state is in RocksDB and restarts from the query's checkpoint.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kept = events.select("trace_id", "sequence", "kind", "seconds", "ts").withWatermark("ts", late)
    return kept.withColumn("bundle", F.shiftright("trace_id", bundle)).groupBy("bundle").transformWithState(_Episodes(Limits(max_steps, max_tools, max_seconds), silence_ms), EPISODE, outputMode="Update", timeMode="EventTime")


def run(rows: DataFrame, out: str, checkpoint: str):
    """Write each micro-batch's rows to ``out/batch=N``, once however often it is run, until the input is read; started again, it goes on where it stopped."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(out: DataFrame) -> DataFrame:
    """The last row of each trace: its columns are those of ``EPISODE``."""
    own = [c.split()[0] for c in EPISODE.split(", ")][1:]
    return out.groupBy("trace_id").agg(F.max_by(F.struct(*own), F.struct("batch", "closed")).alias("e")).select("trace_id", "e.*")
