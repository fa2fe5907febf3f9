"""Continuous ingestion: micro-batches of mutations become segments and tombstones of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NamespaceConfig
from ..sources.mutations import effective, visible
from ..sources.segments import SegmentStore
from ..sources.tables import written


#: Tables of deleted row numbers that a store keeps beside one another, before they become one.
MOST_TABLES = 16


def apply_batch(store: SegmentStore, config: NamespaceConfig, log: DataFrame, number: int | None = None) -> bool:
    """Apply one batch of a mutation log (see sources.mutations.SCHEMA); False if the store says that it has this number already.

    An update or delete is effective only if its row is live just before, an insert only if its row number was never given before: live rows
    of the store enter the log as inserts before all else, row numbers that were deleted earlier as an insert and a delete. Tombstones, segment,
    deleted row numbers and the batch's number are published in one version, so a batch that fails at any point can be applied again.
    """
    manifest = store.manifest()
    if number is not None and manifest.get("batch", -1) >= number:
        return False
    touched, cols = log.select("row_num").distinct(), log.columns
    live = store.visible().join(touched, "row_num", "left_semi")
    before = live.select(F.lit(-1).cast("bigint").alias("seq"), F.lit("I").alias("op"), "row_num", "terms", "values", "metadata")
    dead = manifest.get("dead", [])
    if dead:
        past = store.spark.read.schema("row_num bigint").parquet(*dead).join(touched, "row_num", "left_semi")
        for seq, op in ((-2, "I"), (-1, "D")):
            before = before.unionByName(past.select(F.lit(seq).cast("bigint").alias("seq"), F.lit(op).alias("op"), "row_num"), allowMissingColumns=True)
    whole = written(before.select(cols).unionByName(log), "batch-log")
    after = visible(whole)
    gone = live.select("row_num").join(after.where(F.col("seq") < 0).select("row_num"), "row_num", "left_anti")
    died = effective(whole).where((F.col("op") == "D") & (F.col("seq") >= 0)).select("row_num")
    more: dict = {} if number is None else {"batch": number}
    if len(dead) >= MOST_TABLES:
        died, dead = died.unionByName(store.spark.read.schema("row_num bigint").parquet(*dead)), []
    more["dead"] = [*dead, store.write(died, "dead")]
    store.change(after.where(F.col("seq") >= 0), gone, **more)
    store.compact(config.max_num_searchable_structures - 1)
    return True


def ingest(stream: DataFrame, store: SegmentStore, config: NamespaceConfig, checkpoint: str, **trigger):
    """Start the streaming query. Each micro-batch takes effect once: its number stands in the version that holds its rows."""

    def one(batch: DataFrame, number: int) -> None:
        apply_batch(store, config, batch, number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
