"""Keeping an index up to date from a stream of file versions.

The reference point is the content hash: each micro-batch of (path, content) is reduced to the last
version of each path, held against the index, and only what changed is parsed and merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import text
from tessera.operators import changes
from tessera.operators.store import IndexStore
from tessera.parsing.tables import with_symbols


def merge_batch(store: IndexStore, versions: DataFrame, order: str) -> None:
    """Merges one batch, in one step; a null content removes the path. Running it twice changes nothing more.

    ``order`` names the column by which the last version of a path is told; ties go to the one with the
    greatest content, and any content wins over a removal.
    """
    v = changes.last_writer(versions.select("path", "content", order), "path", [order, "content"])
    fresh = v.where("content is not null").select("path", text.sha256(F.col("content")).alias("hash"), "content")
    changed = changes.changed(fresh, store.files().select("path", "hash"))
    store.merge(with_symbols(changed), removed=v.where("content is null"))


def maintain(versions: DataFrame, store: IndexStore, checkpoint: str, order: str, once: bool = False) -> StreamingQuery:
    """Starts the query that merges a stream of versions."""
    w = versions.writeStream.foreachBatch(lambda batch, _: merge_batch(store, batch, order)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
