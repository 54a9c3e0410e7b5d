"""Keyed rules on streams in event-time order.

Rows wait in a list state until the watermark has passed them; then an event-time timer hands them, sorted, to the rule,
so a row that comes some batches late (within the watermark's delay) is judged where it belongs. What the rule remembers
of a key goes once the watermark is ``silence`` past the key's last row. Rows later than the watermark are dropped by
Spark and counted in the query's progress (``late_rows``); rows without a time are left out. Every call of the state
store costs about a millisecond, so keys are dealt to groups: a group's waiting rows are Arrow batches, and its calls
do not grow with its keys.

A rule is a function (memory, rows) -> (memory, output rows) over arrays: memory is a tuple or None, rows are a pandas
frame in order. The rows of a group that wait are those of the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
Rule = Callable[[tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]]


def _packed(rows: pd.DataFrame) -> bytes:
    batch, out = pa.RecordBatch.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _plain(value):
    """A Python value; missing ones are None."""
    return None if value is None or value is pd.NaT or value != value else value.item() if hasattr(value, "item") else value


class InOrder(StatefulProcessor):
    """The rows of a group of keys. The first of ``columns`` is the key, the last ``event_us``."""

    def __init__(self, columns: list[str], order: list[str], rule: Rule, memory: str, output: list[str], silence_ms: int):
        self.columns, self.order, self.rule = columns, order, rule
        self.memory_schema, self.output, self.silence = memory, output, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.memory = handle.getListState("memory", self.memory_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [part[self.columns] for part in rows if len(part)]
        if parts:
            self.held.appendList([(_packed(part),) for part in parts])
            self.handle.registerTimer(-(-min(int(part["event_us"].min()) for part in parts) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [pa.ipc.open_stream(r[0]).read_pandas() for r in self.held.get()] if self.held.exists() else []
        memory = {m[0]: tuple(m[1:]) for m in self.memory.get()} if self.memory.exists() else {}
        rest = None
        if waiting:
            rows = pd.concat(waiting, ignore_index=True)
            late = (rows["event_us"] > passed).to_numpy()
            ready, rest = rows[~late], rows[late]
            if len(ready):
                out = self._judged(ready, memory)
                if len(rest):
                    self.held.put([(_packed(rest),)])
                else:
                    self.held.clear()
                if len(out):
                    yield out[self.output].astype({c: object for c in self.output if out[c].dtype.kind not in "bif"})
        going = [(k, *m) for k, m in memory.items() if m[-1] + self.silence * 1000 >= passed]
        if going:
            self.memory.put(going)
        else:
            self.memory.clear()
        if rest is not None and len(rest):
            self.handle.registerTimer(-(-int(rest["event_us"].min()) // 1000))
        elif going:
            self.handle.registerTimer(max(m[-1] for m in going) // 1000 + self.silence + 1)

    def _judged(self, rows: pd.DataFrame, memory: dict) -> pd.DataFrame:
        """What the rule gives for the rows of every key; ``memory`` is what it remembers of each then."""
        name = self.columns[0]
        code, keys = pd.factorize(rows[name], use_na_sentinel=False)
        rows = rows.assign(_code=code).sort_values(["_code", "event_us", *self.order], kind="stable", ignore_index=True)
        ends = np.cumsum(np.bincount(code))
        made = []
        for key, start, end in zip(map(_plain, keys), np.concatenate(([0], ends[:-1])), ends):
            mine = rows.iloc[start:end].reset_index(drop=True)
            before = memory.get(key)
            now, out = self.rule(before[:-1] if before else None, mine)
            memory[key] = (*now, int(mine["event_us"].iloc[-1]))
            if len(out):
                out.insert(0, self.output[0], [key] * len(out))
                made.append(out)
        return pd.concat(made, ignore_index=True) if made else pd.DataFrame(columns=self.output)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, time: str, order: list[str], rule: Rule, columns: list[str], memory: str, output: str, delay: str = "0 seconds", silence: str = "10 seconds", groups: int = 256) -> DataFrame:
    """Runs ``rule`` over each key's rows by (time, order). ``columns`` are those that the rule reads, ``memory`` and
    ``output`` are schemas; the output starts with the key's column. Needs the RocksDB state store (``rocks_state``).
    Keys are dealt to ``groups`` by hash, which share calls of the state store; it stays as it is for a checkpoint."""
    used = [c for c in dict.fromkeys([*order, *columns]) if c != key]
    deal = F.pmod(F.hash(key), F.lit(groups)).alias("_group")
    rows = stream.where(F.col(time).isNotNull()).select(deal, key, time, *(c for c in used if c != time), F.unix_micros(F.col(time)).alias("event_us"))
    kind = stream.schema[key].dataType.simpleString()
    ended = int(pd.Timedelta(silence).total_seconds() * 1000)
    made = InOrder([key, *used, "event_us"], order, rule, f"_key {kind}, {memory}, last_us long", [c.split()[0] for c in output.split(", ")], ended)
    return rows.withWatermark(time, delay).groupBy("_group").transformWithStateInPandas(made, output, "append", "EventTime")


class rocks_state:  # noqa: N801
    """Within it, streams that are started keep their state in RocksDB."""

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(PROVIDER)
        self.conf.set(PROVIDER, ROCKS)

    def __exit__(self, *_) -> None:
        self.conf.set(PROVIDER, self.before)


def late_rows(run: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the batches of the query's recent progress."""
    return sum(s.numRowsDroppedByWatermark for p in run.recentProgress for s in p.stateOperators)


def gate_rule(hits: int = 5, seconds: float = 3.0, vehicles: int = 2, ratio: float = 0.75, gap_seconds: float = 10.0, confidence: float = 0.70) -> Rule:
    """The confirmation gate over event_id, t_us, stage, confidence, positive_votes, total_votes: gives event_id, hits,
    accepted, reason. Memory: stage, hits, first and last time of the run that is open (a null stage: none)."""

    def rule(memory: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        t = rows["t_us"].to_numpy(np.int64)
        stage = rows["stage"].to_numpy(float)
        sure = rows["confidence"].astype(float).fillna(0.0).to_numpy()
        for_it, votes = rows["positive_votes"].to_numpy(float), rows["total_votes"].to_numpy(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            agree = (for_it >= vehicles) & (votes > 0) & (for_it / votes >= ratio)
        cases = [np.isnan(stage), sure < confidence, stage == 0, ~agree]
        reasons = ["no_stage", "below_minimum_confidence", "normal_immediate", "insufficient_positive_vehicle_agreement"]
        early = np.select(cases, reasons, "").astype(object)
        is_early = early != ""
        held_stage, held_hits, held_first, held_last = memory or (None, 0, 0, 0)
        before_stage = np.concatenate(([np.nan if held_stage is None else held_stage], stage[:-1]))
        before_early = np.concatenate(([held_stage is None], is_early[:-1]))
        before_t = np.concatenate(([held_last], t[:-1]))
        starts = is_early | before_early | (before_stage != stage) | (t - before_t > gap_seconds * 1e6)
        place = np.arange(len(t))
        first = np.maximum.accumulate(np.where(starts, place, -1))
        going = first < 0  # rows of the run that was open
        count = np.where(going, held_hits + place + 1, place - first + 1)
        lasts = t - np.where(going, held_first, t[np.maximum(first, 0)])
        done = (count >= hits) & (lasts >= seconds * 1e6)
        normal = early == "normal_immediate"
        out = pd.DataFrame({
            "event_id": rows["event_id"],
            "hits": np.where(is_early, np.where(normal, 1, 0), count),
            "accepted": np.where(is_early, normal, done),
            "reason": np.where(is_early, early, np.where(done, "confirmed", "awaiting_repeated_confirmation")),
        })
        if is_early[-1]:
            return (None, 0, 0, 0), out
        return (int(stage[-1]), int(count[-1]), int(t[-1] - lasts[-1]), int(t[-1])), out

    return rule


GATE = dict(columns=["t_us", "event_id", "stage", "confidence", "positive_votes", "total_votes"], memory="stage int, hits int, first long, last long")


def _taken(t: np.ndarray, starts: np.ndarray, apart: float, last: int | None) -> np.ndarray:
    """Places of the rows that are taken: the first at each start, then each one at least ``apart`` after the last
    taken. ``last`` is the time of the one taken before. One step for each taken row, not for each row."""
    begins = np.append(np.flatnonzero(starts), len(t))
    out, at = [], 0
    if len(t) and last is not None and not starts[0]:
        at = min(int(np.searchsorted(t, last + apart)), int(begins[0]))
    while at < len(t):
        out.append(at)
        following = begins[np.searchsorted(begins, at, side="right")]
        at = min(max(int(np.searchsorted(t, t[at] + apart)), at + 1), int(following))
    return np.array(out, int)


def cooldown_rule(seconds: float = 10.0) -> Rule:
    """Saved rows over event_id, t_us, stage. Memory: level and time of the last saved, level of the last row."""

    def rule(memory: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        t, level = rows["t_us"].to_numpy(np.int64), rows["stage"].to_numpy(np.int64)
        starts = np.concatenate(([memory is None or memory[0] != level[0]], level[1:] != level[:-1]))
        kept = _taken(t, starts, seconds * 1e6, memory[1] if memory else None)
        last = int(t[kept[-1]]) if len(kept) else memory[1]
        return (int(level[-1]), last), rows.iloc[kept][["event_id"]].reset_index(drop=True)

    return rule


def alert_rule(frames: int = 5, least: int = 2, seconds: float = 30.0) -> Rule:
    """Alerts over event_id, t_us, stage. Memory: frames in a row that reach ``least``, time of the last alert."""

    def rule(memory: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        row, last = memory or (0, None)
        t, high = rows["t_us"].to_numpy(np.int64), rows["stage"].to_numpy(np.int64) >= least
        place = np.arange(len(t))
        low = np.maximum.accumulate(np.where(high, -1, place))
        in_row = np.where(low < 0, row + place + 1, place - low)
        full = np.flatnonzero(high & (in_row >= frames))
        fresh = np.zeros(len(full), bool)
        if len(full):
            fresh[0] = last is None
        kept = full[_taken(t[full], fresh, seconds * 1e6, last)]
        return (int(min(in_row[-1], frames)), int(t[kept[-1]]) if len(kept) else last), rows.iloc[kept][["event_id"]].reset_index(drop=True)

    return rule


def change_rule() -> Rule:
    """Level changes over event_id, stage: gives event_id, level. Memory: the last level."""

    def rule(memory: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        level = rows["stage"].to_numpy(np.int64)
        changed = np.concatenate(([memory is None or memory[0] != level[0]], level[1:] != level[:-1]))
        return (int(level[-1]),), pd.DataFrame({"event_id": rows["event_id"][changed].to_numpy(), "level": level[changed]})

    return rule


def ema_rule(alpha: float = 0.35, reset_seconds: float = 8.0) -> Rule:
    """Smoothed vote shares over event_id, t_us, p0..p4: gives event_id, ema_stage, ema_confidence. Each row's shares
    rest on the last row's, to the last bit, so that equal shares stay equal. Memory: time and shares of the last row."""

    def rule(memory: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        t, p = rows["t_us"].to_numpy(np.int64), rows[[f"p{k}" for k in range(5)]].to_numpy(float)
        before = np.concatenate(([memory[0] if memory else t[0]], t[:-1]))
        fresh = t - before > reset_seconds * 1e6
        fresh[0] |= memory is None
        out, held = p * alpha, np.array(memory[1:]) if memory else p[0]
        for k in range(len(t)):
            held = p[k] if fresh[k] else out[k] + held * (1 - alpha)
            out[k] = held
        made = pd.DataFrame({"event_id": rows["event_id"], "ema_stage": out.argmax(1), "ema_confidence": out.max(1)})
        return (int(t[-1]), *map(float, held)), made

    return rule
