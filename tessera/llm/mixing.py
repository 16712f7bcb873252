"""Mixing sources to target weights by Pareto order sampling (operator 2).

A source's share of the output is fixed by its weight: total * weight / (sum of weights), rounded so that
the shares add up to the total exactly (the largest remainders are rounded up, ties by name, null last).
Inside a source a document is expected e = share * size / (sum of sizes) times.  The whole copies floor(e)
are certain; the fractional part p = e - floor(e) is an inclusion probability, and exactly sum(p) further
documents (an integer) are drawn by Pareto order sampling: the documents with the least
(u / (1-u)) / (p / (1-p)), u a uniform number that a digest of seed and doc_id gives.

Nothing but (source, size) is needed to decide a document, so the texts are read once for their sizes,
the small table of ids and sizes is kept in the shared folder, and texts are never shuffled.  The
threshold is an exact order statistic: keys are counted in 2^16 slots of their bit pattern per source
(with map-side combining, so a hot source costs no more than another), and only the slot that holds the
threshold is ranked, each distinct key once with its count.  Rows that tie at the threshold are numbered
inside the partitions that hold them, and the partitions' counts are added up, so that exactly the wanted
number of them is drawn however many there are.

Weights default to the square root of the number of documents of a source (temperature 2), the output has
as many documents as the input, and the size of a document is floor(sqrt(characters)) + 1.

Defined cases: a null source is a source of its own, with the weight that ``weights`` gives for None; a
null text has size 1, a very long one counts by all its characters; a null id draws by its text; rows that
repeat an id and size share a number, and where such ties meet the threshold any of them are drawn, as many
as are wanted; a source that ``weights`` omits or gives 0 yields nothing, and if that holds for all the
result is empty; otherwise the result has exactly ``total`` documents; an empty table gives an empty result;
other columns are kept by mix() and ignored by copies().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

SEED, SLOT_BITS = 17, 16
#: Sources whose thresholds are sent to every executor; with more, they are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def _uniform(doc_id: Column, text: Column, seed: int) -> Column:
    name = F.when(doc_id.isNull(), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))).otherwise(doc_id.cast("string"))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 48)


def _size(text: Column) -> Column:
    return F.floor(F.sqrt(F.coalesce(F.length(text), F.lit(0)).cast("double"))).cast("long") + 1


def _plan(slim: DataFrame, weights: dict[str | None, float] | None, total: int | None) -> DataFrame:
    """(src, share, sizes) of every source."""
    per = slim.groupBy("src").agg(F.count("*").alias("docs"), F.sum("size").alias("sizes"))
    if weights is None:
        w = F.floor(F.sqrt(F.col("docs").cast("double")) * 1000).cast("long")
    else:
        pairs = [F.struct(F.lit(k).alias("k"), F.lit(int(v * 1_000_000)).cast("long").alias("v")) for k, v in weights.items() if k is not None]
        named = F.coalesce(F.element_at(F.map_from_entries(F.array(*pairs)), F.col("src")), F.lit(0)) if pairs else F.lit(0)
        w = F.when(F.col("src").isNull(), F.lit(int(weights.get(None, 0) * 1_000_000))).otherwise(named)
    everything = Window.partitionBy(F.lit(0))  # one row for each source
    wanted = F.lit(total).cast("long") if total is not None else F.sum("docs").over(everything)
    known = per.withColumn("w", w.cast("decimal(18,0)")).withColumn("total", wanted.cast("decimal(19,0)")).withColumn("all", F.sum("w").over(everything)).where("w > 0")
    # whole numbers throughout: the product has up to 37 digits
    whole = known.withColumn("share", F.expr("(total * w) div all")).withColumn("rest", F.expr("(total * w) % all"))
    missing = F.max("total").over(everything) - F.sum("share").over(everything)
    largest = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("rest").desc(), F.col("src").asc_nulls_last()))
    return whole.withColumn("up", (largest <= missing).cast("long")).select("src", (F.col("share").cast("long") + F.col("up")).alias("share"), "sizes")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def _drawing(share: Column, size: Column, sizes: Column, u: Column) -> tuple[Column, Column]:
    """Whole copies and Pareto key (null where p is 0)."""
    p = ((share * size) % sizes) / sizes
    return F.floor((share * size - (share * size) % sizes) / sizes).cast("long"), F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def _bits(key: Column) -> Column:
    """Order-preserving integer of a positive double: slots of its logarithm, 2^-9 wide, clipped to 2^16."""
    return F.least(F.greatest(F.floor((F.log2(key) + 64) * (1 << (SLOT_BITS - 7))).cast("long"), F.lit(0)), F.lit((1 << SLOT_BITS) - 1))


def _thresholds(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """(src, last_key, drawn, tied) from (src, whole, key) rows: the key of the last document drawn, how many of that key are drawn, and how many have it."""
    slots = C.checkpointed(keyed.groupBy("src", _bits(F.col("key")).alias("slot")).agg(F.count("key").alias("n"), F.sum("whole").alias("whole")))
    wanted = slots.groupBy("src").agg(F.sum("whole").alias("given")).join(plan, slots["src"].eqNullSafe(plan["src"])).select(slots["src"].alias("s"), (F.col("share") - F.col("given")).alias("m"))
    upto = Window.partitionBy("src").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ranked = slots.where("slot is not null").withColumn("below", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    cut = ranked.join(wanted, ranked["src"].eqNullSafe(F.col("s"))).where("m > below and m <= below + n").select("s", F.col("slot").alias("at"), (F.col("m") - F.col("below")).alias("nth"))
    near = keyed.join(_small(cut, cut.count()), keyed["src"].eqNullSafe(F.col("s")) & (_bits(F.col("key")) == F.col("at")))
    distinct = near.groupBy("s", "nth", "key").agg(F.count("*").alias("tied"))
    before = F.coalesce(F.sum("tied").over(Window.partitionBy("s").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return distinct.withColumn("before", before).where("nth > before and nth <= before + tied").select(F.col("s").alias("src"), F.col("key").alias("last_key"), (F.col("nth") - F.col("before")).alias("drawn"), "tied")


def _first_of_ties(rows: DataFrame, src: str, tied: str, drawn: str) -> DataFrame:
    """Of the rows that are tied, marks the wanted number of each source: adds ``drawn_tie``. Rows are numbered inside partitions."""
    part, nth, before = C.fresh(rows, "tie_part"), C.fresh(rows, "tie_no"), C.fresh(rows, "tie_before")
    own = C.checkpointed(rows.where(tied).withColumn(part, F.spark_partition_id()))
    counts = own.groupBy(F.col(src).alias("s_"), F.col(part).alias("p_")).agg(F.count("*").alias("n_"))
    earlier = counts.select("s_", "p_", F.coalesce(F.sum("n_").over(Window.partitionBy("s_").orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    numbered = own.withColumn(nth, F.row_number().over(Window.partitionBy(src, part).orderBy(F.lit(0))))
    both = numbered.join(earlier, numbered[src].eqNullSafe(F.col("s_")) & (numbered[part] == F.col("p_")))
    return both.select(*rows.columns, (F.col(nth) + F.col(before) <= F.col(drawn)).alias("drawn_tie"))


def _decide(docs: DataFrame, weights: dict[str | None, float] | None, total: int | None, seed: int, slim: DataFrame, full: DataFrame, name: str) -> DataFrame:
    """``full`` (columns of docs, with a source, a size and a number u under fresh names) and the copies of each row."""
    plan = C.checkpointed(_plan(slim, weights, total))
    few = _small(plan, sources := plan.count())
    at = slim.join(few.withColumnRenamed("src", "plan_src"), slim["src"].eqNullSafe(F.col("plan_src")))
    whole, key = _drawing(F.col("share"), F.col("size"), F.col("sizes"), F.col("u"))
    keyed = at.select("src", whole.alias("whole"), key.alias("key"))
    cuts = C.checkpointed(_thresholds(keyed, plan))
    ties = cuts.where("tied > drawn").head() is not None
    columns = docs.columns
    n = {k: C.fresh(full, f"mix_{k}") for k in ("p_src", "p_share", "p_sizes", "c_src", "c_key", "c_drawn", "c_tied", "whole", "key", "tied")}
    p = few.select(F.col("src").alias(n["p_src"]), F.col("share").alias(n["p_share"]), F.col("sizes").alias(n["p_sizes"]))
    c = _small(cuts, sources).select(F.col("src").alias(n["c_src"]), F.col("last_key").alias(n["c_key"]), F.col("drawn").alias(n["c_drawn"]), F.col("tied").alias(n["c_tied"]))
    src, size, u = full.columns[-3:]
    whole, key = _drawing(F.col(n["p_share"]), F.col(size), F.col(n["p_sizes"]), F.col(u))
    rows = full.join(p, full[src].eqNullSafe(F.col(n["p_src"])), "left").withColumn(n["whole"], F.coalesce(whole, F.lit(0))).withColumn(n["key"], key)
    rows = rows.join(c, rows[src].eqNullSafe(F.col(n["c_src"])), "left")
    below = F.coalesce(F.col(n["key"]) < F.col(n["c_key"]), F.lit(False))
    level = F.coalesce(F.col(n["key"]) == F.col(n["c_key"]), F.lit(False))
    result = lambda d, drawn: d.select(*columns, (F.col(n["whole"]) + drawn.cast("long")).alias(name))
    if not ties:
        return result(rows, below | level)
    many = level & (F.col(n["c_tied"]) > F.col(n["c_drawn"]))
    flagged = rows.withColumn(n["tied"], many)
    apart = _first_of_ties(flagged, src, n["tied"], n["c_drawn"])
    return result(flagged.where(~F.col(n["tied"])), below | level).unionByName(result(apart, F.col("drawn_tie")))


def _slim(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, src, size, u), read once from the texts and kept."""
    d = C.require(docs, "doc_id", "source", "text")
    return C.checkpointed(d.select("doc_id", F.col("source").alias("src"), _size(F.col("text")).alias("size"), _uniform(F.col("doc_id"), F.col("text"), seed).alias("u")))


def copies(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, copies) of every document; 0 where it isn't drawn."""
    slim = _slim(docs, seed)
    full = slim.select("doc_id", F.col("src").alias("source"), F.col("src").alias("mix_src"), F.col("size").alias("mix_size"), F.col("u").alias("mix_u"))
    return _decide(full.select("doc_id", "source"), weights, total, seed, slim, full, "copies")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """The documents, each as many times as it was drawn, with their columns."""
    slim = _slim(docs, seed)
    s, z, u = (C.fresh(docs, f"mix_{k}") for k in ("src", "size", "u"))
    full = docs.select("*", docs["source"].alias(s), _size(docs["text"]).alias(z), _uniform(docs["doc_id"], docs["text"], seed).alias(u))
    n, i = C.fresh(docs, "copies_"), C.fresh(docs, "copy_no")
    drawn = _decide(docs, weights, total, seed, slim, full, n)
    return drawn.where(F.col(n) > 0).withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).drop(n, i)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(C.read(spark, sf_dir, "documents"))


SQL = f"""
WITH base AS (SELECT doc_id, source, CAST(floor(sqrt(CAST(coalesce(length(text), 0) AS DOUBLE))) AS BIGINT) + 1 AS size, CASE WHEN doc_id IS NULL THEN 't' || md5(coalesce(text, '')) ELSE CAST(doc_id AS VARCHAR) END AS name FROM documents),
per AS (SELECT source, count(*) AS docs, CAST(sum(size) AS BIGINT) AS sizes, CAST(floor(sqrt(CAST(count(*) AS DOUBLE)) * 1000) AS BIGINT) AS w FROM base GROUP BY source),
product AS (SELECT source, sizes, CAST((SELECT sum(docs) FROM per) AS HUGEINT) AS total, CAST((SELECT sum(docs) FROM per) AS HUGEINT) * w AS tw, CAST((SELECT sum(w) FROM per) AS HUGEINT) AS ws FROM per),
floors AS (SELECT source, sizes, total, tw // ws AS share, row_number() OVER (ORDER BY tw % ws DESC, source ASC NULLS LAST) AS nth FROM product),
plan AS (SELECT source, sizes, CAST(share + CASE WHEN nth <= total - sum(share) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM floors),
e AS (SELECT b.doc_id, b.source, share, (share * size) // sizes AS whole, CAST((share * size) % sizes AS DOUBLE) / CAST(sizes AS DOUBLE) AS p, (CAST(('0x' || substr(md5('{SEED}:' || name), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM base b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source),
k AS (SELECT doc_id, source, share, whole, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS key FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key NULLS LAST) AS nth, share - sum(whole) OVER (PARTITION BY source) AS m FROM k)
SELECT doc_id, source, CAST(whole + CASE WHEN nth <= m AND key IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r
"""
