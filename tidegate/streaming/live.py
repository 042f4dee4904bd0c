"""Structured Streaming: the same rules as a stateful operator.

Rules whose state is by subject run with one key per subject; programs whose rules feed one another
or read last values share state across subjects and run under one key. The machine's state is
kept with its key as one value, timers are event-time timers, and rows of a batch are put in order
before they are fed. Event time never goes back within a key.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegate.engine import _uses
from tidegate.lang.program import Program, load
from tidegate.runtime.machine import Machine
from tidegate.session import ship

OUT = "path string, rule_idx int, ts_ms bigint, subject string, payload string, payload_num double, depth int, source string"
#: Provider that keeps state on disk, which stateful operators with timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RuleProcessor(StatefulProcessor):
    def __init__(self, source: str, spelling: str = "edn"):
        self.source, self.spelling = source, spelling

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("machine", "blob binary")
        self.program = load(self.source, self.spelling)

    def machine(self) -> Machine:
        held = self.kept.get() if self.kept.exists() else None
        if held is None:
            return Machine(self.program)
        state, lvc, started, last = pickle.loads(bytes(held[0]))
        m = Machine(self.program, state=state)
        m.lvc, m.started, m.last_ts = lvc, started, last
        return m

    def keep(self, m: Machine) -> None:
        self.kept.update((pickle.dumps((m.state, m.lvc, m.started, m.last_ts)),))
        wanted = {s["due"] for s in m.state.values() if isinstance(s, dict) and s.get("due") is not None}
        have = set(self.handle.listTimers())
        have = {t[0] if isinstance(t, tuple) else t for t in have}
        for t in have - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - have:
            self.handle.registerTimer(t)

    @staticmethod
    def frame(found: list) -> Iterator[pd.DataFrame]:
        if found:  # an empty frame can't be returned
            yield pd.DataFrame([(",".join(map(str, e.path)), e.rule, e.ts, e.subject, e.payload, e.number, e.depth, e.source) for e in found], columns=["path", "rule_idx", "ts_ms", "subject", "payload", "payload_num", "depth", "source"]).astype({"rule_idx": "int32", "depth": "int32", "payload_num": "float64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        m = self.machine()
        every = pd.concat(list(rows)).sort_values("seq", kind="stable")
        found = []
        for r in every.itertuples():
            found += m.feed(int(r.seq), int(r.ts_ms), r.subject, r.payload or "", r.reply_to, int(r.wall_ms), bool(r.replaying)).emissions
        self.keep(m)
        yield from self.frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        m = self.machine()
        found = m.finish(expiredTimerInfo.getExpiryTimeInMs()).emissions
        self.keep(m)
        yield from self.frame(found)

    def close(self) -> None:
        pass


def by_subject(program: Program) -> bool:
    """Whether all state of a program belongs to single subjects."""
    return not any(r.reentrant or r.every_ms is not None or _uses(r.body, "last") for r in program.rules)


def emissions(messages: DataFrame, source: str, spelling: str = "edn", delay: str = "0 seconds") -> DataFrame:
    """Emissions of a program over a streaming message table. The session needs PROVIDER as its
    state store. Timers fire as the watermark passes them."""
    ship(messages.sparkSession)
    program = load(source, spelling)
    timed = messages.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", delay)
    keyed = timed.withColumn("key", F.col("subject") if by_subject(program) else F.lit(""))
    return keyed.groupBy("key").transformWithStateInPandas(RuleProcessor(source, spelling), OUT, "append", "EventTime")
