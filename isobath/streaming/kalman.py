"""The online form of the state-space filter: one scalar Kalman filter per series over a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "series long, t long, mean double, variance double"


def scalar_filter(rows, state, a: float, q: float, r: float):
    """Filtered (t, mean, variance) of sorted (t, y) rows, and the new state (mean, variance)."""
    out = []
    for t, y in rows:
        if state is None:
            state = (float(y), r)
        else:
            mean, var = a * state[0], a * a * state[1] + q
            gain = var / (var + r)
            state = (mean + gain * (float(y) - mean), (1.0 - gain) * var)
        out.append((int(t), *state))
    return out, state


def filter_stream(stream: DataFrame, a: float = 1.0, q: float = 1.0, r: float = 1.0) -> DataFrame:
    """(series, t, y) to filtered means and variances; the state per series is two numbers.

    Rows of a series must arrive in order of t across micro-batches; within one they are sorted.
    """

    def run(key, batches, state: GroupState):
        now = tuple(state.get) if state.exists else None
        pdf = pd.concat(list(batches)).sort_values("t")
        out, now = scalar_filter(zip(pdf["t"], pdf["y"], strict=True), now, a, q, r)
        state.update(now)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["series", "t", "mean", "variance"])

    return stream.groupBy("series").applyInPandasWithState(run, OUTPUT, "mean double, variance double", "append", GroupStateTimeout.NoTimeout)


def filter_batch(traces: DataFrame, a: float = 1.0, q: float = 1.0, r: float = 1.0) -> DataFrame:
    """The same filter over a table: a fold over each series in order of t, linear in its length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        out, _ = scalar_filter(zip(pdf["t"], pdf["y"], strict=True), None, a, q, r)
        return pd.DataFrame([(pdf["series"].iloc[0], *o) for o in out], columns=["series", "t", "mean", "variance"])

    return traces.select("series", "t", "y").groupBy("series").applyInPandas(run, OUTPUT)
