"""Keyed lifecycle state on a stream of change events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "doc_id string, seq long, op string, retired long, live long"
_STATE = "live long, last long"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    live, last = state.get if state.exists else (0, 0)
    for pdf in [pd.concat(list(batches)).sort_values("seq")]:
        rows = []
        for seq, op in zip(pdf["seq"], pdf["op"]):
            if seq <= last:
                continue  # a replayed event changes nothing
            retired = live if op in ("update", "delete") else 0
            live = live - retired + (op != "delete")
            last = int(seq)
            rows.append((key[0], last, op, retired, live))
        state.update((int(live), last))
        yield pd.DataFrame(rows, columns=["doc_id", "seq", "op", "retired", "live"])


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """Per event: how many chunks of its document it retired and how many are live now.

    The state of a document is two numbers, however long its history.
    """
    return events.select("doc_id", "seq", "op").groupBy("doc_id").applyInPandasWithState(
        _step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout
    )
