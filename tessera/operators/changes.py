"""Operators on keyed tables: changed rows, upserts, deletes, last-writer-wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(new: DataFrame, old: DataFrame, key: str = "path", version: str = "hash") -> DataFrame:
    """Rows of ``new`` whose key is unknown to ``old`` or has another version there (null-safe)."""
    was = old.select(F.col(key).alias("_key"), F.col(version).alias("_version"))
    return new.join(was, new[key] == was["_key"], "left").where(F.col("_key").isNull() | ~new[version].eqNullSafe(F.col("_version"))).select(*[new[c] for c in new.columns])


def change_set(new: DataFrame, old: DataFrame, key: str = "path", version: str = "hash") -> DataFrame:
    """(key, change): ADD, DEL, MOD or SAME for every key of either side."""
    a = new.select(F.col(key).alias("_a"), F.col(version).alias("_va"))
    b = old.select(F.col(key).alias("_b"), F.col(version).alias("_vb"))
    change = F.when(F.col("_b").isNull(), "ADD").when(F.col("_a").isNull(), "DEL").when(F.col("_va").eqNullSafe(F.col("_vb")), "SAME").otherwise("MOD")
    return a.join(b, a["_a"] == b["_b"], "full").select(F.coalesce("_a", "_b").alias(key), change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(table: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    """The table without the rows whose key is listed; with symbols for a table this is the cascade."""
    return table.join(keys.select(key), key, "left_anti")


def present(table: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """The rows whose key is in the listing."""
    return table.join(listing.select(key), key, "left_semi")


def last_writer(rows: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """One row for each key, the one that comes last in the order; partial maxima are taken before the shuffle."""
    keys, by = [key] if isinstance(key, str) else key, [order] if isinstance(order, str) else order
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_last")).select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns])


def duplicates(rows: DataFrame, version: str = "hash") -> DataFrame:
    """(version, n) of the versions that more than one row has."""
    return rows.groupBy(version).agg(F.count("*").alias("n")).where("n > 1")
