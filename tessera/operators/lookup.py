"""Lookups on the index tables: search, symbol and file contents, outlines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tessera.functions import skeleton, text

#: Bytes of parts that one automaton searches for.
PARTS_BYTES = 16 << 20
#: Files, with their symbols, that one task brings together.
TASK_FILES = 50_000


def search(symbols: DataFrame, query: str) -> DataFrame:
    """(id) of the symbols whose name contains the query."""
    return symbols.where(text.name_contains(F.col("name"), query)).select("id")


def symbol_contents(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, content bytes) of the symbols."""
    return symbols.join(files.select("path", "content"), "path").select("id", "path", text.byte_slice(F.col("content"), F.col("byte_offset"), F.col("byte_length")).alias("content"))


def grouped_symbols(symbols: DataFrame) -> DataFrame:
    """(path, symbols): an array for each file, by place."""
    s = F.struct("byte_offset", "ord", "kind", "name", F.col("byte_offset").alias("start"), (F.col("byte_offset") + F.col("byte_length")).alias("end"), F.col("name").alias("qualified_name"), "body_start", "body_end")
    return symbols.groupBy("path").agg(F.array_sort(F.collect_list(s)).alias("symbols"))


def files_with_symbols(files: DataFrame, symbols: DataFrame, few: bool = False) -> DataFrame:
    """Every file with the array of its symbols; null where it has none.

    More tasks than the session's setting are made where there are more files than TASK_FILES for each, as sorts and arrays
    fill a task's memory otherwise; ``few`` says that there aren't, which saves counting them.
    """
    n = 0 if few else -(-files.count() // TASK_FILES)
    if n > int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        files, symbols = files.repartition(n, "path"), symbols.repartition(n, "path")
    return files.join(grouped_symbols(symbols), "path", "left")


def outlines(files: DataFrame, symbols: DataFrame, few: bool = False) -> DataFrame:
    """(path, outline): the skeleton of each file; the text itself where it has no symbols."""
    both = files_with_symbols(files.select("path", "content"), symbols, few)
    return both.select("path", skeleton.elide(text.decoded(F.col("content")).cast("binary"), F.col("symbols")).alias("outline"))


def signatures(symbols: DataFrame) -> DataFrame:
    """(path, signatures): "Kind Name" of each symbol, by place."""
    return grouped_symbols(symbols).select("path", F.transform("symbols", lambda s: F.concat(s["kind"], F.lit(" "), s["name"])).alias("signatures"))


def containing(left: DataFrame, right: DataFrame, text_column: Column, part: Column, most: int = PARTS_BYTES) -> DataFrame:
    """Pairs in which a text of ``left`` contains a part of ``right``, with the columns of both.

    The parts are searched all at once: an automaton of the distinct parts passes over each text, and what it
    finds is joined to ``right`` by equality.  An automaton holds ``most`` bytes of parts; more parts are cut
    into blocks, each with a pass of its own.  Null texts and parts match nothing, an empty part every text.
    """
    spark = left.sparkSession
    parts = right.select(part.alias("part")).where(F.col("part").isNotNull()).distinct()
    size = parts.agg(F.coalesce(F.sum(F.octet_length("part")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // most))
    text_at, found_at = _unused(left, right, "text_"), _unused(left, right, "found_")
    texts, out = left.withColumn(text_at, text_column), None
    schema = StructType([*left.schema.fields, StructField(found_at, ArrayType(StringType()))])
    for k in range(blocks):
        words = [r.part for r in parts.where(F.pmod(F.xxhash64("part"), F.lit(blocks)) == k).toLocalIterator()]
        found = texts.mapInArrow(_finder(spark.sparkContext.broadcast(words), texts.columns.index(text_at), found_at), schema).where(F.size(found_at) > 0)
        out = found if out is None else out.unionByName(found)
    pairs = out.select(*[F.col(c) for c in left.columns], F.explode(found_at).alias(found_at))
    keyed = right.withColumn(text_at, part)
    return pairs.join(keyed, pairs[found_at] == keyed[text_at]).drop(found_at, text_at)


def _finder(shared, at: int, into: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, every = ahocorasick.Automaton(), [""] if "" in shared.value else []
        for w in shared.value:
            if w:
                automaton.add_word(w, w)
        if len(automaton):
            automaton.make_automaton()
        for b in batches:
            found = [None if t is None else every + sorted({w for _, w in automaton.iter(t)} if len(automaton) else ()) for t in b.column(at).to_pylist()]
            columns = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.string()))], names=[*(n for i, n in enumerate(b.schema.names) if i != at), into])

    return run


def _unused(left: DataFrame, right: DataFrame, stem: str) -> str:
    taken = {c.lower() for c in left.columns + right.columns}
    while stem in taken:
        stem = "_" + stem
    return stem
