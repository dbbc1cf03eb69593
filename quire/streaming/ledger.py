"""ST1 as a stream: last write wins for each key, state without end, no watermark (ST9)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.state import KEY, accepted

STATE = "v string, t double, d int, seq long"
CHANGE = "book string, kind string, key string, v string, t double, d int, seq long"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = state.get if state.exists else None
    start = best
    for frame in frames:
        for v, t, d, seq in frame[["v", "t", "d", "seq"]].itertuples(index=False):
            if best is None or t > best[1] or (t == best[1] and start is None and seq < best[3]):
                best = (None if d or pd.isna(v) else v, float(t), int(d), int(seq))
    if best != start:
        state.update(best)
        yield pd.DataFrame([[*key, *best]], columns=[*KEY, "v", "t", "d", "seq"])


def changes(entries: DataFrame) -> DataFrame:
    """A stream of the entries that newly count. Of one batch's entries with equal t the smallest seq counts; a stored one stays.

    entries: a stream of book, kind, key, v, t, d, seq. Write the result in update mode; its last row for
    a key is the key's state.
    """
    return accepted(entries).groupBy(*KEY).applyInPandasWithState(_fold, CHANGE, STATE, "update", GroupStateTimeout.NoTimeout)


def upsert_batches(entries: DataFrame, store: str, checkpoint: str, trigger: dict | None = None):
    """ST5: the same by merging each micro-batch into a table; versions are folders store/v=n, of which the largest complete one counts.

    A batch that is run again after a failure writes its folder anew, so each batch counts once.
    """
    from quire.operators.state import merged

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{store}/v={n - 1}") if n else spark.createDataFrame([], CHANGE)
        merged(before, batch).write.mode("overwrite").parquet(f"{store}/v={n}")

    stream = entries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()
