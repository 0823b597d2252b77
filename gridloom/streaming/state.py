"""Running state per channel: the online variance, as a stateful operator on variance estimates."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fillers import OnlineMaskFiller, clamp_step

SCHEMA = "v1_idx long, freq int, var double, w double"
STATE = "last long, var double, w double"


def running_variance(v1: DataFrame, filler: OnlineMaskFiller) -> DataFrame:
    """(v1_idx, freq, var, w) of a stream of (v1_idx, freq, v1), which must come in order of v1_idx from batch to batch.

    State is three numbers per channel. Estimates older than the state are late and dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, var, w = state.get if state.exists else (-1, 0.0, 0.0)
        rows = sorted((int(k), float(v)) for f in frames for k, v in zip(f["v1_idx"], f["v1"], strict=True))
        out: list[tuple[Any, ...]] = []
        for k, v in rows:
            if k <= last:
                continue
            w = max(0.0, w - (k - last - 1) * filler.w_clamp)
            var, w = clamp_step(var, w, v, filler)
            last = k
            out.append((k, int(key[0]), var, w))
        state.update((last, var, w))
        yield pd.DataFrame(out, columns=["v1_idx", "freq", "var", "w"])

    return v1.groupBy("freq").applyInPandasWithState(step, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)
