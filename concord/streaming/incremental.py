"""Streams of list changes that go on only if they differ from what was synchronised before.

What a list had last is keyed state of the stream, one digest for each service and list: a batch reads and writes the state of its own lists only. The state
becomes valid together with the batch. A batch that fails in its effects starts again from the state before it, and changes that come again later pass nothing on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from concord.functions.ids import members_digest

#: Keeps the state on local disk with its changes in the checkpoint, so that it may be larger than memory.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

OUT = "op string, service string, entity_id string, members array<string>, op_key string, digest string"


def _changed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of a list's changes those that differ from the state before them; a create of a known list becomes an update."""
    known = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("ord", kind="stable")  # the changes of one list in one batch
    out = []
    for r in rows.to_dict("records"):
        if r["digest"] == known:
            continue
        op, name = r["op"], r["op_key"]
        if known is not None and op == "create_list":
            op, name = "update_members", f"update_members:{r['service']}-{r['entity_id']}:{r['digest']}"
        known = r["digest"]
        out.append((op, r["service"], r["entity_id"], r["members"], name, known))
    if known is not None:
        state.update((known,))
    yield pd.DataFrame(out, columns=["op", "service", "entity_id", "members", "op_key", "digest"])


def changed_stream(changes: DataFrame) -> DataFrame:
    """Operations of a stream without list operations that change nothing; those on tracks pass. Several of one list in a batch go by ``ord``, if there is one."""
    ops = changes if "ord" in changes.columns else changes.withColumn("ord", F.lit(0).cast("long"))
    own = ops.withColumn("digest", F.when(F.col("members").isNotNull(), members_digest(F.col("members")))).select("op", "service", "entity_id", "members", "op_key", "digest", "ord")
    lists = own.where("members IS NOT NULL").groupBy("service", "entity_id").applyInPandasWithState(_changed, OUT, "digest string", "append", GroupStateTimeout.NoTimeout)
    return own.where("members IS NULL").drop("ord").unionByName(lists).drop("digest")


def synchronise(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``apply(ops, batch)`` on the operations of each micro-batch that change something.

    The state's size follows the number of lists, not time, so no watermark is needed. ``checkpoint`` is a folder that all executors share.
    """
    spark = changes.sparkSession
    if spark.conf.get(PROVIDER[0], None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(*PROVIDER)
    return changed_stream(changes).writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

