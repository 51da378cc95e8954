"""Live takes: frames of a stream of audio blocks, equal to those of the whole take."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import Analysis
from ..operators.analysis import FRAMES, MOST_SEC, Tracker

STATE = "tail binary, first long, skip long, at long"


def live_frames(blocks: DataFrame, settings: Analysis = Analysis()) -> DataFrame:
    """Frames of streamed rows (take_id, sample_rate, start_sample, samples), as soon as their windows are full.

    The state of a take is less than a window of samples and three counts. Blocks of one micro-batch are put
    in order; a take's blocks must come in order over micro-batches. Null samples, null blocks and gaps read
    as silence, what overlaps an earlier block is left out, and a take ends at MOST_SEC, as in analyse().
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("start_sample", kind="stable")
        tail, first, skip, at = state.get if state.exists else (b"", 0, 0, 0)
        rate = int(rows["sample_rate"].iloc[0])
        tracker = Tracker(rate, settings, np.frombuffer(tail), first, skip)
        most, pieces = int(MOST_SEC * rate), [np.empty(0)]
        for start, block in zip(rows["start_sample"], rows["samples"], strict=True):
            if block is None or pd.isna(start) or not 0 <= start < most:
                continue
            own = np.nan_to_num(np.asarray(block, dtype=np.float64))[max(0, at - int(start)) : most - int(start)]
            if len(own):
                pieces += [np.zeros(max(0, int(start) - at)), own]
                at += len(pieces[-2]) + len(own)
        out = tracker.push(np.concatenate(pieces))
        state.update((tracker.tail.tobytes(), tracker.first, tracker.skip, at))
        out.insert(0, "take_id", key[0])
        yield out

    needed = blocks.select("take_id", "sample_rate", "start_sample", "samples")
    return needed.groupBy("take_id").applyInPandasWithState(run, FRAMES, STATE, "append", "NoTimeout")
