"""An append-only log as a stream that keeps a table of its latest rows, in a store of versioned tables.

The stream holds no state: each micro-batch is reduced to its latest row a key and put into the buckets of the store that
its keys fall into, where the newer row wins.  The batch's number is published with its rows, so a batch that is
delivered again after a crash changes nothing, whichever of the two checkpoints got further.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.manifest import latest
from ..sources.store import Change, Store


def newer(have: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the one with the greater order."""
    return latest(have.unionByName(new), key, order).select(*have.columns)


def into_store(store: Store, table: str, stream: str, order: str = "line_no", after: Callable[[int], None] = lambda batch: None) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls to keep a table of the store, keyed by one column, at the latest rows of a stream.

    `after` is called once a batch is published, for tests of what a crash does there.
    """

    def put(batch: DataFrame, number: int) -> None:
        def change(c: Change) -> bool:
            if c.entry.setdefault("streams", {}).get(stream, -1) >= number:
                return False
            (key,) = c.entry["tables"][table]["key"]
            c.merge(table, latest(batch.where(F.col(key).isNotNull()), key, order), lambda have, new: newer(have, new, key, order))
            c.entry["streams"][stream] = number
            return True

        store.apply(change)
        after(number)

    return put


def compact(rows: DataFrame, store: Store, table: str, checkpoint: str, order: str = "line_no", after: Callable[[int], None] = lambda batch: None) -> StreamingQuery:
    """Start keeping a table at the latest rows of a stream of log lines, until there are no more.  The checkpoint names the stream."""
    if table not in store.entry()["tables"]:
        raise ValueError(f"the store has no table {table}")
    writer = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(into_store(store, table, checkpoint, order, after)).start()
