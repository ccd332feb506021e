"""The stored table of stores: find-or-create by (user_id, name) from concurrent batches (JOIN-5).

Rows lie in ``BUCKETS`` folders by the hash of (user_id, name); a manifest names the folder of each
(``TableSet``).  A batch reads only the buckets that its names fall into, rewrites those that get a new
name, and publishes them as one commit.  If another batch published first, a batch whose buckets are
untouched publishes the same folders again on the newer manifest; otherwise it looks its names up anew.
So a name gets one row whatever runs at the same time, and a repeated batch changes nothing.

Rows without a name or user are no store and are left out; a name that repeats in the batch is one store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .commits import Conflict, TableSet

BUCKETS = 64
TABLE = "stores"


def _name(bucket: int) -> str:
    return f"{TABLE}-{bucket:03d}"


def _schema(user_type: str) -> str:
    return f"user_id {user_type}, name string, store_key string"


def _rows(tables: TableSet, manifest: dict, names: list[str], user_type: str) -> DataFrame:
    folders = [f"{tables.root}/{f}" for n in names for f in manifest["tables"].get(n, [])]
    if not folders:
        return tables.spark.createDataFrame([], _schema(user_type))
    return tables.spark.read.schema(_schema(user_type)).parquet(*folders)


def stores(tables: TableSet, user_type: str = "bigint") -> DataFrame:
    """All stores as of the newest commit: (user_id, name, store_key)."""
    manifest = tables.manifest()
    return _rows(tables, manifest, [n for n in manifest["tables"] if n.startswith(f"{TABLE}-")], user_type)


def merge_stores(tables: TableSet, batch: DataFrame) -> int:
    """Create the stores of ``batch (user_id, name[, store_key])`` that are not in the table; returns how many were new.

    A new store keeps the ``store_key`` that the batch gives (the smallest, if several), else it gets a
    digest of its user and name, so a batch that is run again after a lost executor gives the same keys.
    """
    kind = batch.schema["user_id"].dataType.simpleString()
    given = F.min("store_key") if "store_key" in batch.columns else F.lit(None).cast("string")
    digest = F.concat(F.lit("new-"), F.md5(F.concat_ws("|", F.col("user_id").cast("string"), F.col("name"))))
    names = (batch.filter("user_id IS NOT NULL AND name IS NOT NULL").groupBy("user_id", "name").agg(given.alias("_key"))
             .select("user_id", "name", F.coalesce("_key", digest).alias("store_key"),
                     F.pmod(F.xxhash64(F.col("user_id").cast("string"), "name"), F.lit(BUCKETS)).cast("int").alias("bucket")))
    names = materialize(names, "store_names")
    touched = _buckets(names)
    seen = None  # the touched buckets as they were when the names were looked up
    while True:
        now = tables.manifest()
        state = [now["tables"].get(_name(b)) for b in touched]
        if seen is None or state != seen:
            seen = state
            known = _rows(tables, now, [_name(b) for b in touched], kind)
            fresh = materialize(names.join(known, ["user_id", "name"], "left_anti"), "store_fresh")
            dirty = _buckets(fresh)
            if not dirty:
                return 0
            kept = _rows(tables, now, [_name(b) for b in dirty], kind).withColumn(
                "bucket", F.pmod(F.xxhash64(F.col("user_id").cast("string"), "name"), F.lit(BUCKETS)).cast("int"))
            folder = tables.stage(TABLE, kept.unionByName(fresh.select(kept.columns)), partition_by="bucket")
            made = fresh.count()
        try:
            if tables.commit([now["version"] + 1], None, {_name(b): f"{folder}/bucket={b}" for b in dirty}, now):
                return made
        except Conflict:
            pass  # someone else's commit went through; look again


def _buckets(rows: DataFrame) -> list[int]:
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most BUCKETS
