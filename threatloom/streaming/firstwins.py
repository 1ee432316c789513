"""First-wins deduplication of a stream over all history: the row of least order stays, whenever it arrives.

The batch form (``dataset.first_wins``) knows all rows. A stream of feeds does not: a row of a feed with a higher
priority may come batches later and take a text over. Each text's least order so far is kept as state; rows that lower it
are delivered, and the least of a text's delivered rows is its winner at any time.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from threatloom.functions import text as tx
from threatloom.operators import dataset as ds

#: States that need the embedded store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The rows of a hot text go to so many first-level states.
SALTS = 64
_KEY, _SALT = "__hash", "__salt"


class LeastOrder(StatefulProcessor):
    """Hands on the rows that lower the least ``order`` seen of their key; the state is one BIGINT a key."""

    def __init__(self, order: str) -> None:
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.least = handle.getValueState("least", T.StructType([T.StructField("least", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = min(rows, key=itemgetter(self.order), default=None)
        known = self.least.get()
        if best is not None and (known is None or best[self.order] < known[0]):
            self.least.update((best[self.order],))
            yield best

    def close(self) -> None:
        pass


def first_wins_stream(rows: DataFrame, key: Column, order: str, salts: int = SALTS) -> DataFrame:
    """The rows of a stream that take their key over: ``winners`` of them is ``dataset.first_wins`` of all rows so far.

    ``order`` is a unique BIGINT. Two levels of state, by key and a salt of the order and then by key alone: the rows of
    a key that holds a third of the stream meet in ``salts`` tasks, and only those that are least there go on. State is
    one number a key and is never forgotten, as all history counts. Rows with a NULL key or order are dropped.
    """
    names = rows.columns
    keyed = rows.withColumns({_KEY: key, _SALT: F.pmod(F.xxhash64(order), F.lit(salts)).cast("int")}).where(
        F.col(_KEY).isNotNull() & F.col(order).isNotNull())
    first = keyed.groupBy(_KEY, _SALT).transformWithState(LeastOrder(order), keyed.schema, "append", "none")
    out = first.groupBy(_KEY).transformWithState(LeastOrder(order), first.schema, "append", "none")
    return out.select(*names, _KEY)


def winners(delivered: DataFrame, order: str) -> DataFrame:
    """The winners among all delivered rows; a row that a restart delivers twice counts once."""
    unique = delivered.dropDuplicates([order])
    return ds.first_wins(unique, F.col(_KEY), order).drop(_KEY)


def aggregate_stream(feeds: DataFrame, **options) -> DataFrame:
    """A stream of ``text, label, source, content_type, order`` as the rows that take their text over."""
    return first_wins_stream(ds.nonblank(feeds, "text"), tx.norm_hash(F.col("text")), "order", **options)


def aggregated(delivered: DataFrame) -> DataFrame:
    """``dataset.aggregate_feeds`` of all feeds so far, from what ``aggregate_stream`` delivered."""
    return ds.known_labels(winners(delivered, "order"), "label")


def run(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is available now into one parquet folder a micro-batch; a repeated batch overwrites its own."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        query = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()  # the setting is read when the query plans its batches
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return query
