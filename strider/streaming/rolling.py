"""Rolling prediction as a stateful stream: a frame takes what the model says from the last boundary of its clip."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "clip long, frame long, signal double, model double"
STATE = "b array<long>, v array<double>, f array<long>, w array<double>, last_ms long"

Model = Callable[[np.ndarray, np.ndarray], np.ndarray]


def drifting(at_boundary: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The stub model: the boundary's value and a tenth for each step."""
    return at_boundary + 0.1 * steps


def _stepper(step: int, model: Model, blocks: int, idle_ms: int):
    """The function of one clip's new frames and its state: values at its last boundaries, and frames that came before their boundary."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        b, v, f, w, last_ms = state.get if state.exists else ([], [], [], [], 0)
        now, held = pd.concat(list(batches)), dict(zip(b, v))
        last_ms = max(last_ms, int(now["at"].max().value // 1_000_000))
        came = pd.DataFrame({"frame": [*f, *now["frame"]], "signal": [*w, *now["signal"]]}).astype({"frame": "int64", "signal": "float64"})
        new = came[came["frame"] % step == 0]
        held |= dict(zip(new["frame"].tolist(), new["signal"].tolist()))
        at = came["frame"] // step * step
        ready = at.isin(list(held))
        waiting, last = came[~ready], sorted(held)[-blocks:]
        state.update((last, [held[k] for k in last], waiting["frame"].tolist(), waiting["signal"].tolist(), last_ms))
        state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs()) + idle_ms)
        done, at = came[ready], at[ready]
        yield pd.DataFrame({"clip": key[0], "frame": done["frame"], "signal": done["signal"], "model": model(at.map(held).to_numpy(float), (done["frame"] - at).to_numpy(float))})

    return run


def rolling(stream: DataFrame, step: int, model: Model = drifting, blocks: int = 16, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """OUT from a stream of clip, frame, signal, at (when it was seen); over all of a stream the rows of windows.boundaries().

    Frames may come in any order within `blocks` boundaries. A clip is dropped once the watermark, `late` behind the
    newest row, is `idle_ms` past its last frame; what still waits for a boundary then has no prediction, as in the batch
    join. Event time decides, so a replay drops the same clips. Rows with a null are left out.
    """
    keyed = stream.select(F.col("clip").cast("long"), F.col("frame").cast("long"), F.col("signal").cast("double"), F.col("at").cast("timestamp")).na.drop().withWatermark("at", late)
    return keyed.groupBy("clip").applyInPandasWithState(_stepper(step, model, blocks, idle_ms), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run(predicted: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Append to Parquet all that is there and stop; with the same checkpoint it goes on, exactly once."""
    return predicted.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()
