"""Replay of stored signals in steps of time, and the alert hub's memory."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import keyframes
from ..operators.latest import of_vehicle, time_window

STEP_US = 250_000


class Replay:
    """A cursor over `signals` (with t_us). Each push gives (cursor, cursor + step]; it jumps over gaps and starts again at the end, with the next epoch.

    With `boxes` (with t_us), `push_all` adds the keyframes of the step.
    """

    def __init__(self, signals: DataFrame, step_us: int = STEP_US, limit: int = 200, boxes: DataFrame | None = None, keyframes: int = 50):
        self.signals, self.step_us, self.limit, self.boxes, self.keyframes = signals, step_us, limit, boxes, keyframes
        self.cursor: int | None = None
        self.epoch = 0

    def push(self, vehicle: str | None = None) -> tuple[int, int, DataFrame] | None:
        """Start, end and rows of the next step. The cursor moves only after every query of the step has run."""
        span = self.signals.agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi")).first()
        if span["lo"] is None:
            return None
        at, epoch = self.cursor, self.epoch
        if at is None or at >= span["hi"]:
            at, epoch = span["lo"] - 1, epoch + (at is not None)
        end = min(at + self.step_us, span["hi"])
        following = self.signals.where(F.col("t_us") > at).agg(F.min("t_us").alias("t")).first()["t"]
        if following > end:
            at = following - 1
            end = min(at + self.step_us, span["hi"])
        rows = of_vehicle(time_window(self.signals, at, end, "t_us"), vehicle).orderBy("t_us", "seq", "vehicle_id").limit(self.limit)
        self.cursor, self.epoch = end, epoch
        return at, end, rows

    def push_all(self, vehicle: str | None = None) -> dict | None:
        """What a client gets of a step: epoch and whether it is new, the span, a batch of signals for each vehicle, and the step's keyframes, `keyframes` of them at the most, in order of time."""
        before = self.epoch if self.cursor is not None else -1
        step = self.push(vehicle)
        if step is None:
            return None
        at, end, rows = step
        batches = rows.groupBy("vehicle_id").agg(F.min("t_us").alias("t_us"), F.count(F.lit(1)).alias("n"))
        frames = None
        if self.boxes is not None:
            mine = of_vehicle(time_window(self.boxes, at, end, "t_us"), vehicle)
            frames = keyframes(mine).withColumn("t_us", F.unix_micros("sensor_time")).orderBy("t_us", "vehicle_id", "sample_id").limit(self.keyframes)
        return {"epoch": self.epoch, "new_epoch": self.epoch != before, "from": at, "to": end, "signals": rows, "batches": batches, "keyframes": frames}

    def frames(self, n: int) -> Iterator[tuple[int, int, DataFrame]]:
        for _ in range(n):
            step = self.push()
            if step is None:
                return
            yield step


class AlertHub:
    """The last `capacity` alerts by id; a repeated id is ignored."""

    def __init__(self, capacity: int = 1000):
        self.capacity = capacity
        self.held: OrderedDict[str, dict] = OrderedDict()

    def publish(self, alert: dict) -> bool:
        if alert["event_id"] in self.held:
            return False
        self.held[alert["event_id"]] = alert
        if len(self.held) > self.capacity:
            self.held.popitem(last=False)
        return True

    def after(self, last_id: str | None, vehicle: str | None = None) -> list[dict]:
        """Alerts after an id; all that are held if the id isn't known."""
        alerts = list(self.held.values())
        ids = list(self.held)
        if last_id in self.held:
            alerts = alerts[ids.index(last_id) + 1 :]
        return [a for a in alerts if not vehicle or not vehicle.strip() or a["vehicle_id"] == vehicle]
