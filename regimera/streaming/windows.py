"""Count windows over a stream of cycles, and a library that grows with every micro-batch.

The reference behaviour is batch only; this is the same window as the batch operator, held per unit as a ring buffer in
keyed state. State is `size` values for each unit, so it grows with the units alive, not with the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shipping import ship
from ..sources.store import append_library

OUT = "unit_id bigint, cycle bigint, mean double, std double, slope double, range double, iqr double"
STATE = "cycles array<bigint>, samples array<double>"


def window_row(unit: int, cycles: list[int], values: list[float]) -> tuple:
    """The statistics of one full window, keyed by its middle cycle."""
    x = np.asarray(values, float)
    std = float(x.std())
    slope = float(np.polyfit(np.arange(len(x)), x, 1)[0]) if std > 1e-12 else 0.0
    q75, q25 = np.percentile(x, [75, 25])
    return unit, cycles[len(cycles) // 2], float(x.mean()), std, slope, float(x.max() - x.min()), float(q75 - q25)


def rolling_stream(stream: DataFrame, size: int = 30) -> DataFrame:
    """stream: (unit_id, cycle, value), cycles of a unit in order over the batches. A row for each full window of `size` cycles."""
    ship(stream.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cycles, values = ([list(x) for x in state.get] if state.exists else ([], []))
        arrived = pd.concat(list(batches)).sort_values("cycle")
        rows = []
        for c, v in zip(arrived["cycle"].tolist(), arrived["value"].tolist()):
            cycles, values = [*cycles, c][-size:], [*values, v][-size:]
            if len(values) == size:
                rows.append(window_row(key[0], cycles, values))
        state.update((cycles, values))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    picked = stream.selectExpr("cast(unit_id as bigint) unit_id", "cast(cycle as bigint) cycle", "cast(value as double) value")
    return picked.groupBy("unit_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def library_sink(entries: DataFrame, path: str, checkpoint: str):
    """A started query that appends pattern-library entries of each micro-batch to the library folder."""
    return entries.writeStream.foreachBatch(lambda batch, _: append_library(batch, path)).option("checkpointLocation", checkpoint).start()
