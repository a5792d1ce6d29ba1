"""Runs state machines over sorted tables and over streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .machines import Machine


def _plain(row: dict) -> dict:
    """Pandas' missing numbers as None, maps as dicts, numpy scalars as Python's."""
    out = {}
    for k, v in row.items():
        if isinstance(v, list) and v and isinstance(v[0], tuple):
            v = dict(v)
        elif hasattr(v, "item") and not isinstance(v, (bytes, str)):
            v = v.item()
        out[k] = None if v is None or v is pd.NA or v is pd.NaT else v
    return out


def _frame(events: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([e.get(n) for e in events], dtype=object) for n in names})


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def over_table(df: DataFrame, machine: type[Machine], key: str, order: list[str], close_ms: int | None = None, **options) -> DataFrame:
    """One machine per key over rows in the given order.

    Rows are dealt by key, sorted, and streamed past the machine, so that a key's rows are never
    held together. With `close_ms` each key's deadlines up to then fire at its end.
    """
    schema, names = machine.schema, _names(machine.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, current = object(), None
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                row = _plain(row)
                if row["_key"] != at:
                    if current is not None and close_ms is not None:
                        out += current.advance(close_ms)
                    at, current = row["_key"], machine(**options)
                out += current.step(row)
            yield _frame(out, names)
        if current is not None and close_ms is not None:
            yield _frame(current.advance(close_ms), names)

    keyed = df.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit("")))
    return keyed.repartition("_key").sortWithinPartitions("_key", *order).mapInPandas(run, schema)


def over_stream(df: DataFrame, machine: type[Machine], key: str, order: list[str], timers: bool = False, **options) -> DataFrame:
    """The same for a streaming frame. State is one JSON text per key; deadlines fire by processing time.

    Within a batch, rows are put in order first: a group's iterator has no order of its own. So one key's rows of a micro-batch
    are held together; the source's limit on files or offsets a trigger bounds them.
    """
    schema, names = machine.schema, _names(machine.schema)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = machine(json.loads(state.get[0]) if state.exists else None, **options)
        out = []
        if state.hasTimedOut:
            out += current.advance(state.getCurrentProcessingTimeMs())
        else:
            rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
            for row in rows.to_dict("records"):
                out += current.step(_plain(row))
        state.update((json.dumps(current.freeze()),))
        due = current.deadline() if timers else None
        if due is not None:
            state.setTimeoutDuration(max(1, int(due - state.getCurrentProcessingTimeMs())))
        yield _frame(out, names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", timeout)
