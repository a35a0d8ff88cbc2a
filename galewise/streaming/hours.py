"""Live hour windows: twelve slot totals for each hour that begins informatively, as the batch operator gives them.

The state of an hour is twelve sums and counts, and how many rows of its first slot have the flag; it is there from the hour's first row until
the watermark passes its end. Then the first slot decides whether the hour stays, slots that are missing repeat the last one, and the state
is gone, so that no hour tells another anything.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SLOTS, MINUTES = 12, 5
STATE = "totals array<double>, seen array<long>, informative long"
OUTPUT = "hour timestamp, n_informative long, sequence array<double>"


def filled(totals: list[float], seen: list[int], informative: int) -> list[float] | None:
    """The hour's values, or None where its first slot is missing or has no row with the flag."""
    if not informative:
        return None
    out: list[float] = []
    for total, n in zip(totals, seen, strict=True):
        out.append(total if n else out[-1])
    return out


def hour_sequences(observations: DataFrame, above: float, late: str = "50 minutes") -> DataFrame:
    """(hour, n_informative, sequence) of a stream (ts timestamp, value), one row for each hour, once the watermark has passed its end.

    A row is informative if its value is above a bound; null values and times count for nothing. Rows later than the watermark are dropped;
    rows of an hour may come in any order. Repeated rows count each."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        totals, seen, informative = state.get if state.exists else ([0.0] * SLOTS, [0] * SLOTS, 0)
        totals, seen = list(totals), list(seen)
        if state.hasTimedOut:
            state.remove()
            sequence = filled(totals, seen, informative)
            if sequence:
                yield pd.DataFrame({"hour": [key[0]], "n_informative": [informative], "sequence": [sequence]})
            return
        for batch in batches:
            for slot, own in batch.groupby("slot")["value"]:
                totals[slot] += float(own.sum())
                seen[slot] += len(own)
                informative += int((own > above).sum()) if slot == 0 else 0
        state.update((totals, seen, informative))
        end = pd.Timestamp(key[0]) + datetime.timedelta(minutes=SLOTS * MINUTES)
        state.setTimeoutTimestamp(int(end.timestamp() * 1000))

    rows = observations.filter("ts is not null and value is not null and not isnan(value)").withWatermark("ts", late)
    keyed = rows.select("ts", F.date_trunc("hour", "ts").alias("hour"), F.floor(F.minute("ts") / MINUTES).cast("int").alias("slot"), "value")
    return keyed.groupBy("hour").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
