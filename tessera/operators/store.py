"""The index on disk: files and symbols as Parquet, in buckets of paths, under numbered manifests.

A merge writes what has changed, in a folder of its own, as a new layer of the buckets that it touches, and then
a manifest that lists the layers; nothing else is rewritten.  In a bucket the last layer that names a path holds
its rows (none, if the path was removed).  A bucket that has MAX_LAYERS is compacted by the merge that touches
it next.  Readers see one manifest or the next, never a mix.  A lookup by path or symbol reads one bucket.

The number of buckets is chosen when the first rows are written, for BUCKET_BYTES of content each, or given;
in a bucket rows lie in as many files as FILE_BYTES asks for.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.operators import changes
from tessera.parsing.tables import exploded
from tessera.schema import FILES, SYMBOL_ARRAY, SYMBOLS

TABLES = {"files": FILES, "symbols": SYMBOLS}
MAX_LAYERS, BUCKET_BYTES, FILE_BYTES, MAX_BUCKETS = 8, 1 << 28, 1 << 27, 1 << 16


class IndexStore:
    """``buckets`` counts when the first rows are written (None: by their size); later it is read from the manifest."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/manifests"))
        self._default = buckets

    # ------------------------------------------------------------ manifests

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._Path(f"{self.path}/manifests"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def manifest(self) -> dict:
        if not (v := self.version()):
            return {"buckets": 0, "layers": {}}
        stream = self._fs.open(self._Path(f"{self.path}/manifests/{v:012d}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _publish(self, manifest: dict, after: int) -> None:
        hidden = self._Path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(hidden)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self._Path(f"{self.path}/manifests/{after + 1:012d}.json")
        if not self._claim(hidden, final):
            self._fs.delete(hidden, False)
            raise RuntimeError("the index has been changed by another writer meanwhile; run the merge again")

    def _claim(self, hidden, final) -> bool:
        """Gives the file its final name unless another has it: one step, whoever else tries."""
        if self._fs.getScheme() == "file":
            try:
                os.link(hidden.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            self._fs.delete(hidden, False)
            return True
        # rename doesn't overwrite on HDFS and is one step there
        return not self._fs.exists(final) and self._fs.rename(hidden, final)

    # ------------------------------------------------------------ reading

    def _read(self, table: str, buckets: set[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The visible rows of a table, of all buckets or some."""
        m = manifest or self.manifest()
        layers = {int(b): v for b, v in m["layers"].items() if buckets is None or int(b) in buckets}
        plain = self._scan(table, [(b, v[0]) for b, v in layers.items() if len(v) == 1])
        several = [(b, f) for b, v in layers.items() if len(v) > 1 for f in v]
        out = plain.select(*TABLES[table].names)
        if several:
            paths = self._scan("paths", [(b, f) for b, f in several if f != layers[b][0]])
            last = paths.groupBy("path").agg(F.max("layer").alias("last_layer"))
            rows = self._scan(table, several).join(last, "path", "left").where(F.coalesce("last_layer", "layer") == F.col("layer"))
            out = out.unionByName(rows.select(*TABLES[table].names))
        return out

    def _scan(self, table: str, places: list[tuple[int, str]]) -> DataFrame:
        """Rows of (bucket, folder) pairs as they lie there, with the number of their layer."""
        schema = StructType([*(TABLES[table].fields if table in TABLES else [StructField("path", StringType())])])
        found = [p for b, f in places if self._fs.exists(self._Path(p := f"{self.path}/{f}/{table}/bucket={b}"))]
        if not found:
            return self.spark.createDataFrame([], StructType([*schema.fields, StructField("layer", LongType())]))
        rows = self.spark.read.schema(schema).parquet(*found)
        return rows.withColumn("layer", F.regexp_extract(F.col("_metadata.file_path"), r"/data/(\d+)-", 1).cast("long"))

    def files(self) -> DataFrame:
        return self._read("files")

    def symbols(self) -> DataFrame:
        return self._read("symbols")

    def bucket(self, path: str, manifest: dict) -> int:
        return zlib.crc32(path.encode()) % max(1, manifest["buckets"])

    def file(self, path: str) -> DataFrame:
        m = self.manifest()
        return self._read("files", {self.bucket(path, m)}, m).where(F.col("path") == path)

    def symbol(self, symbol_id: str) -> DataFrame:
        """The row of a symbol; its path ends at one of the double colons."""
        m, parts = self.manifest(), symbol_id.split("::")
        near = {self.bucket("::".join(parts[:k]), m) for k in range(1, len(parts))}
        return self._read("symbols", near, m).where(F.col("id") == symbol_id)

    def file_hash(self, path: str) -> str | None:
        row = self.file(path).select("hash").head()
        return row.hash if row else None

    def symbols_of(self, path: str) -> DataFrame:
        """The rows of a file's symbols, from its bucket."""
        m = self.manifest()
        return self._read("symbols", {self.bucket(path, m)}, m).where(F.col("path") == path)

    def file_symbols(self, path: str) -> DataFrame:
        return self.symbols_of(path).orderBy("byte_offset", "ord").select("kind", "name")

    def symbol_content(self, symbol_id: str) -> bytes | None:
        from tessera.operators.lookup import symbol_contents

        s = self.symbol(symbol_id).head()
        if s is None:
            return None
        one = self.spark.createDataFrame([s], SYMBOLS)
        row = symbol_contents(one, self.file(s.path)).head()
        return bytes(row.content) if row else None

    # ------------------------------------------------------------ writing

    def merge(self, parsed: DataFrame, removed: DataFrame | None = None) -> None:
        """Replaces the files of (path, hash, content, symbols array) and their symbols; removes those of ``removed`` (path)."""
        rows = parsed.select("path", "hash", "content", "symbols", F.lit(False).alias("gone"))
        if removed is not None:
            none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("hash", "content", "symbols")]
            rows = rows.unionByName(removed.select("path", *none, F.lit(True).alias("gone")))
        # written in columns, not as a checkpoint: what follows reads some columns at a time, and rows with arrays take many times their room
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(staged)
            self._add(self.spark.read.schema(rows.schema).parquet(staged))
        finally:
            self._fs.delete(self._Path(staged), True)

    def delete(self, paths: DataFrame) -> None:
        """Removes files and, with them, their symbols."""
        self.merge(self.spark.createDataFrame([], StructType([*FILES.fields, StructField("symbols", SYMBOL_ARRAY)])), removed=paths)

    def upsert_file(self, path: str, content: bytes, hash: str | None = None, symbols: list[dict] | None = None) -> None:
        """One file, with the symbols given (as parsing.tables.symbols_of makes them) instead of its old ones."""
        one = (path, hash or hashlib.sha256(content).hexdigest(), content, symbols)
        self.merge(self.spark.createDataFrame([one], StructType([*FILES.fields, StructField("symbols", SYMBOL_ARRAY)])))

    def insert_symbol(self, path: str, symbol: dict) -> None:
        """Adds a symbol to a file, or puts it in the place of the one with its qualified name."""
        row = self.file(path).head()
        if row is None:
            raise LookupError(f"no such file in the index: {path}")
        old = [
            {"name": s.name, "qualified_name": s.name, "kind": s.kind, "start": s.byte_offset, "end": s.byte_offset + s.byte_length, "body_start": s.body_start, "body_end": s.body_end, "ord": s.ord, "last": True}
            for s in self.symbols_of(path).collect() if s.name != symbol["qualified_name"]  # one file's
        ]
        self.upsert_file(path, bytes(row.content), row.hash, old + [symbol | {"last": True}])

    def _add(self, delta: DataFrame) -> None:
        m, after = self.manifest(), self.version()
        size = delta.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes")).first()
        if not size.n:
            return
        if not m["buckets"]:
            m["buckets"] = self._default or min(MAX_BUCKETS, max(16, -(-size.bytes // BUCKET_BYTES)))
        n = m["buckets"]
        bucket = lambda c: F.pmod(F.crc32(F.encode(c, "utf-8")), F.lit(n)).cast("int")
        touched = {r[0] for r in delta.select(bucket(F.col("path"))).distinct().collect()}  # n numbers at most
        full = {b for b in touched if len(m["layers"].get(str(b), [])) >= MAX_LAYERS}
        folder = f"data/{after + 1:012d}-{uuid.uuid4().hex}"
        kept = delta.where(~F.col("gone"))
        rows = {"files": kept.select("path", "hash", "content"), "symbols": exploded(kept.where("symbols is not null"))}
        # the paths of a bucket's first layer hide nothing and are never read
        later = sorted(b for b in touched - full if m["layers"].get(str(b)))
        if later:
            rows["paths"] = delta.select("path").where(bucket(F.col("path")).isin(later))
        several = max(1, -(-size.bytes // (len(touched) * FILE_BYTES)))
        for table, new in rows.items():
            if table in TABLES:
                new = new.select(*TABLES[table].names)
                if full:
                    new = new.unionByName(changes.delete(self._read(table, full, m), delta.select("path")))
            placed = new.withColumn("bucket", bucket(F.col("path"))).repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(several)))
            placed.sortWithinPartitions("bucket", "id" if table == "symbols" else "path").write.partitionBy("bucket").parquet(f"{self.path}/{folder}/{table}")
        for b in touched:
            m["layers"][str(b)] = [folder] if b in full else [*m["layers"].get(str(b), []), folder]
        self._publish(m, after)
