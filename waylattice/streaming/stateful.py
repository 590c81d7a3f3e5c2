"""Operators with state per entity: each runs over a table in order, or over a stream.

A step object holds the state of one entity; ``advance`` takes a row and returns
the columns it adds. In batch, rows are sorted within partitions and pass
through in Arrow batches, so memory holds one batch and one state however long
an entity is. In a stream the pickled state is kept per entity between batches.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.blocks import runs, window
from ..session import ship_package


def _wrap(a: float) -> float:
    return (a + math.pi) % (2 * math.pi) - math.pi


class MotionFilter:
    """Keeps a pose when it is far from the last kept one in distance, angle or time; the first is kept."""

    ADDS = "keep BOOLEAN, moved DOUBLE, turned DOUBLE, waited DOUBLE"

    def __init__(self, distance: float, angle: float, seconds: float, least=(0.05, math.radians(0.5)), most=(0.5, math.radians(10.0))):
        self.distance, self.angle, self.seconds = min(max(distance, least[0]), most[0]), min(max(angle, least[1]), most[1]), seconds
        self.last: tuple | None = None

    @classmethod
    def from_velocity(cls, period: float, speed: float, turn_rate: float) -> MotionFilter:
        """Thresholds of what is covered in a period at the expected speed."""
        return cls(speed * period, turn_rate * period, period)

    def advance(self, row: Any) -> tuple:
        if self.last is None:
            self.last = (row.x, row.y, row.theta, row.t)
            return True, 0.0, 0.0, 0.0
        x, y, theta, t = self.last
        moved, turned, waited = math.hypot(row.x - x, row.y - y), abs(_wrap(row.theta - theta)), row.t - t
        keep = moved > self.distance or turned > self.angle or waited > self.seconds
        if keep:
            self.last = (row.x, row.y, row.theta, row.t)
        return keep, moved, turned, waited


class Debounce:
    """Drops a pose that is near the last one let through in both distance and angle."""

    ADDS = "similar BOOLEAN"

    def __init__(self, distance: float, angle: float):
        self.distance, self.angle, self.last = distance, angle, None

    def advance(self, row: Any) -> tuple:
        if self.last is not None:
            x, y, theta = self.last
            if math.hypot(row.x - x, row.y - y) < self.distance and abs(_wrap(row.theta - theta)) < self.angle:
                return (True,)
        self.last = (row.x, row.y, row.theta)
        return (False,)


class Submaps:
    """Assigns scans to submaps: two are active; the older is finished at ``size`` scans and leaves when the younger has half of them."""

    ADDS = "inserted ARRAY<BIGINT>, active ARRAY<BIGINT>, finished ARRAY<BIGINT>"

    def __init__(self, size: int):
        self.size, self.next, self.active = size, 0, []  # active: [id, scans, finished]

    def _open(self) -> None:
        self.active.append([self.next, 0, False])
        self.next += 1

    def _finish(self) -> list[int]:
        oldest = self.active[0]
        if not oldest[2] and oldest[1] >= self.size:
            oldest[2] = True
            return [oldest[0]]
        return []

    def advance(self, row: Any) -> tuple:
        while len(self.active) < 2:
            self._open()
        inserted = [m[0] for m in self.active if not m[2]]
        active = [m[0] for m in self.active]
        for m in self.active:
            m[1] += not m[2]
        done = self._finish()
        if self.active[0][2] and self.active[1][1] >= self.size // 2:
            self.active.pop(0)
            self._open()
            done += self._finish()
        return inserted, active, done


class ConsistencyGroups:
    """Counts in how many queries in a row a candidate's group overlaps one of the query before; ``candidates`` are (id, group) pairs of one query.

    Groups of the query before are found by their members, so a query costs as
    much as its groups have members, however many groups there are.
    """

    ADDS = "consistent ARRAY<BIGINT>, groups INT, most_consistent INT"

    def __init__(self, threshold: int = 3):
        self.threshold = threshold
        # of the query before and of this one: best consistency of a member's groups, groups of a member, and (groups of equal members, best consistency)
        self.best, self.of_member, self.groups = {}, {}, []
        self.claimed: list[bool] = []
        self._now = ({}, {}, [])

    def _judge(self, candidate: int, members: Iterable[int]) -> bool:
        """Whether the next candidate of the query passes."""
        group = {int(m) for m in members} | {candidate}
        most = max((self.best[m] for m in group if m in self.best), default=None)
        count, n = (1, 0) if most is None else (0, 0)
        if most is not None:  # each earlier group goes on in the first group that meets it
            for m in group:
                for i in self.of_member.pop(m, ()):
                    if not self.claimed[i]:
                        self.claimed[i] = True
                        count, n = count + self.groups[i][0], max(n, self.groups[i][1] + 1)
        if count:
            best, of_member, groups = self._now
            for m in group:
                best[m] = max(best.get(m, 0), n)
                of_member.setdefault(m, []).append(len(groups))
            groups.append((count, n))
        return most is not None and most + 1 >= self.threshold

    def _close(self) -> None:
        """Ends the query."""
        self.best, self.of_member, self.groups = self._now
        self.claimed = [False] * len(self.groups)
        self._now = ({}, {}, [])

    def advance(self, row: Any) -> tuple:
        passed = {}
        for candidate, members in zip(row.candidates if row.candidates is not None else [], row.members if row.members is not None else []):
            if self._judge(int(candidate), members):
                passed[int(candidate)] = True
        self._close()
        return list(passed), sum(c for c, _ in self.groups), max((n for _, n in self.groups), default=0)


class CandidateConsistency(ConsistencyGroups):
    """The same with a row per candidate, so that no row holds a query's candidates; its group is the keyframes within ``reach`` of it. A row without ``found`` stands for a query that has none."""

    ADDS = "passed BOOLEAN"

    def __init__(self, threshold: int = 3, reach: int = 5):
        super().__init__(threshold)
        self.reach, self.query = reach, None

    def advance(self, row: Any) -> tuple:
        if self.query is not None and row.query != self.query:
            self._close()
        self.query = row.query
        if not row.found:
            return (False,)
        c = int(row.candidate)
        return (self._judge(c, range(max(0, c - self.reach), c + self.reach + 1)),)


class Extrapolator:
    """Predicts each pose from the velocity of the last ``seconds`` and then learns it; steps longer than ``cap`` are predicted as ``cap``."""

    ADDS = "predicted_x DOUBLE, predicted_y DOUBLE, predicted_theta DOUBLE"

    def __init__(self, seconds: float = 1.5, cap: float = 0.5):
        self.seconds, self.cap, self.queue = seconds, cap, []

    def advance(self, row: Any) -> tuple:
        out = (None, None, None)
        if self.queue:
            t0, x0, y0, h0 = self.queue[0]
            t1, x1, y1, h1 = self.queue[-1]
            dt, step = t1 - t0, min(max(row.t - t1, 0.0), self.cap)
            v = ((x1 - x0) / dt, (y1 - y0) / dt, _wrap(h1 - h0) / dt) if dt > 0 else (0.0, 0.0, 0.0)
            out = (x1 + v[0] * step, y1 + v[1] * step, _wrap(h1 + v[2] * step))
        self.queue.append((row.t, row.x, row.y, row.theta))
        while len(self.queue) > 1 and row.t - self.queue[0][0] > self.seconds:
            self.queue.pop(0)
        return out


class TrackingStates:
    """Tracking: not initialised until the first success, then OK, LOST on failure, OK again when relocalised."""

    ADDS = "state STRING, was STRING"

    def __init__(self):
        self.state = "NOT_INITIALIZED"

    def advance(self, row: Any) -> tuple:
        was = self.state
        good = bool(row.relocalised) if was == "LOST" else bool(row.tracked)
        self.state = "OK" if good else ("NOT_INITIALIZED" if was == "NOT_INITIALIZED" else "LOST")
        return self.state, was


class Tracking:
    """Frame by frame: which reference a frame is tracked against, the state that follows, and whether the motion model may be used next.

    Rows say what each attempt would give: ``initialised`` (a first map can be
    made), ``by_motion`` (against the frame before, from the predicted pose),
    ``by_keyframe`` (against the reference keyframe), ``in_map`` (enough of the
    local map is found) and ``relocalised``; null counts as failure. Without a
    motion model only the keyframe is tried; a pose needs the local map too. A lost
    frame asks for relocalisation, after which the model stays off for that frame
    and the next one.
    """

    ADDS = "was STRING, state STRING, how STRING, model BOOLEAN"

    def __init__(self):
        self.state, self.model, self.rest = "NO_IMAGES_YET", False, 0

    def _attempt(self, row: Any) -> str | None:
        if self.state != "OK":
            return "relocalised" if row.relocalised else None
        how = "motion" if self.model and row.by_motion else "keyframe" if row.by_keyframe else None
        return how if how and row.in_map else None

    def advance(self, row: Any) -> tuple:
        was, how = self.state, None
        if was in ("NO_IMAGES_YET", "NOT_INITIALIZED"):
            how = "initial" if row.initialised else None
            self.state, self.model = ("OK" if how else "NOT_INITIALIZED"), False
            return was, self.state, how, self.model
        how = self._attempt(row)
        if how == "relocalised":
            self.rest = 2
        self.state = "OK" if how else "LOST"
        self.model = how is not None and self.rest == 0
        self.rest = max(0, self.rest - 1)
        return was, self.state, how, self.model


def _columns(step: type) -> list[str]:
    return [c.split()[0] for c in step.ADDS.split(", ")]


def in_order(df: DataFrame, by: str, order: list[str], make: Callable[[], Any]) -> DataFrame:
    """Batch form: the rows of each entity in order through a step of its own."""
    ship_package(df.sparkSession)
    adds = make().ADDS
    names = _columns(make())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step = None, None
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                k = getattr(row, by)
                if step is None or k != key:
                    key, step = k, make()
                out.append(step.advance(row))
            yield rows.assign(**{n: pd.Series([o[i] for o in out], index=rows.index, dtype=object) for i, n in enumerate(names)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.where(F.col(by).isNotNull()).repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, f"{fields}, {adds}")


def in_runs(df: DataFrame, by: str, order: list[str], begins: Column, make: Callable[[], Any]) -> DataFrame:
    """``in_order`` for steps that forget: an entity is cut where ``begins`` holds, and its runs pass side by side.

    ``begins`` must hold only where the step's answers don't depend on the rows
    before; it may look one row back (``blocks.runs``).
    """
    cut_up = runs(df.where(F.col(by).isNotNull()), by, order, begins, "run_start").withColumn("run_key", F.concat_ws(":", F.col(by).cast("string"), F.col("run_start").cast("string")))
    return in_order(cut_up, "run_key", order, make).drop("run_key", "run_start")


def motion_runs(seconds: float, by: str) -> Column:
    """A pose after a longer wait than the motion filter's is kept whatever was before."""
    return F.col("t") - F.lag("t").over(window(by)) > seconds


def debounce_runs(distance: float, angle: float, by: str) -> Column:
    """A pose twice as far from the one before as the filter reaches is let through: the last one let through is within its reach of the one before."""
    w, far = window(by), 2 * (1 + 1e-9)
    turned = F.abs(F.pmod(F.col("theta") - F.lag("theta").over(w) + math.pi, F.lit(2 * math.pi)) - math.pi)
    return (F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) >= far * distance) | (turned >= far * angle)


def submaps_of(place: Column, size: int) -> Column:
    """The submaps (array) into which ``Submaps`` puts the scan at a place from 0 of its order.

    The first two fill together and finish together; the next one fills half
    alone; from then on one goes on every ``size`` scans, two at a time.
    """
    if size < 2:
        raise ValueError("a submap holds two scans at least")
    half = size // 2
    later = place - (size + half)
    q, odd = F.floor(later / size).cast("bigint"), (F.pmod(later, F.lit(size)) >= size - half).cast("bigint")
    older = q * 2 + 2 + odd
    two, zero, one = (F.lit(i).cast("bigint") for i in (2, 0, 1))
    return F.when(place < size, F.array(zero, one)).when(later < 0, F.array(two)).otherwise(F.array(older, older + 1))


def over_stream(df: DataFrame, by: str, order: list[str], make: Callable[[], Any], *, idle: str = "1 hour") -> DataFrame:
    """Streaming form: state per entity in the state store; rows of a micro-batch are put in order first, an entity idle for so long starts anew."""
    ship_package(df.sparkSession)
    adds = make().ADDS
    names = _columns(make())
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        step = pickle.loads(state.get[0]) if state.exists else make()
        rows = pd.concat(list(batches)).sort_values(order)
        out = [step.advance(row) for row in rows.itertuples(index=False)]
        state.update((pickle.dumps(step),))
        state.setTimeoutDuration(milliseconds)
        yield rows.assign(**{n: pd.Series([o[i] for o in out], index=rows.index, dtype=object) for i, n in enumerate(names)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.where(F.col(by).isNotNull()).groupBy(by).applyInPandasWithState(run, f"{fields}, {adds}", "step BINARY", "append", GroupStateTimeout.ProcessingTimeTimeout)


def split_late(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event-time stream with a watermark: rows later than ``delay`` behind are dropped by the operators that follow."""
    return df.withWatermark(ts, delay)


def windowed_counts(df: DataFrame, ts: str, by: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Rows per entity and tumbling (or sliding) window of event time, emitted when the watermark passes."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.withWatermark(ts, delay).groupBy(w, by).agg(F.count("*").alias("n")).select(by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(df: DataFrame, ts: str, by: str, gap: str, delay: str | None = None) -> DataFrame:
    """Runs of each entity without a gap longer than ``gap``: a new trajectory begins after one."""
    base = df.withWatermark(ts, delay) if delay else df
    return base.groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def late_split(df: DataFrame, ts: str, arrived: str, seconds: float) -> DataFrame:
    """Adds ``lag`` (arrival less time of the event, in seconds) and ``late``: rows for a side table of those beyond ``seconds``."""
    lag = F.col(arrived) - F.col(ts)
    return df.withColumn("lag", lag).withColumn("late", F.coalesce(F.col("lag") > seconds, F.lit(False)))
