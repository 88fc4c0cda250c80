"""Budgeted append on streams: the fold of `operators.thread.admitted` with a running total as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admitted_stream(messages: DataFrame, max_memory: int, by: str = "conversation_id") -> DataFrame:
    """The messages (by, seq, tokens_count, ...) that fit, each judged once as it arrives; within a batch in order of seq.

    A null count is 0. The state is one number a thread. A null key is a thread of its own.
    """

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        keep = []
        for n in rows["tokens_count"].fillna(0).astype("int64"):
            fits = total + n <= max_memory
            total += int(n) if fits else 0
            keep.append(fits)
        state.update((total,))
        yield rows[pd.Series(keep, index=rows.index, dtype=bool)] if len(set(rows.index)) == len(rows) else rows.iloc[[i for i, k in enumerate(keep) if k]]

    return messages.groupBy(by).applyInPandasWithState(admit, messages.schema, "total long", "append", GroupStateTimeout.NoTimeout)
