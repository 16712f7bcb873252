"""Language identification (operator 4).

Sparse multinomial logistic regression on TF-IDF character n-grams (see linear.py), trained with
follow-the-regularised-leader and elastic-net penalties on at most SAMPLE labelled rows, taken as evenly from
all languages as they allow so that a rare one is learned too, then temperature-calibrated on a held-out fifth
of them.  All texts are scored whole, however long.

A document is rejected where the calibrated probability of the best language is below
MIN_CONFIDENCE or the text holds no letter.

Defined cases: null and letterless texts get a null language and confidence 0 and are rejected; null
labels aren't trained on; null or repeated ids are scored like others, and an id is trained on once for each
label, with the least of its texts; with no labelled row every
document is rejected; with one label it is given to all texts with letters; an empty table gives an
empty result; ties go to the first language in alphabetical order; other columns are kept by
accepted() and ignored by identify().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import linear

SAMPLE, MIN_CONFIDENCE = 4000, 0.5


def train(docs: DataFrame, rows: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and weight table."""
    xs, ys = linear.sample(docs, F.col("lang"), rows, fold=True)
    names = sorted(set(ys))
    if len(names) < 2:
        return names, np.zeros((linear.DIM + 1, max(1, len(names))), np.float32)
    index = {k: i for i, k in enumerate(names)}
    model = linear.Model(len(names), fold=True).fit(xs, np.eye(len(names))[[index[y] for y in ys]])
    return names, model.table()


def _classify(col: pa.Array, names: list[str], table: np.ndarray, least: float):
    best, conf = [], []
    for _, _, d, o in C.pieces(*C.buffers(col)):
        s, _ = linear.scores(d, o, table, fold=True)
        p = linear.softmax(s)
        cp, co = linear.codepoints(d, o, fold=True)
        letters = np.r_[0, np.cumsum(cp != 32)][co]
        b, c = p.argmax(1), p.max(1)
        none = np.diff(letters) == 0
        best.append(np.where(none, -1, b)), conf.append(np.where(none, 0.0, c))
    b = np.concatenate(best) if best else np.zeros(0, np.int64)
    c = np.concatenate(conf) if conf else np.zeros(0)
    if not names:
        b, c = np.full(len(b), -1), np.zeros(len(c))
    return b, c, (b >= 0) & (c >= least)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, least: float = MIN_CONFIDENCE) -> DataFrame:
    """(doc_id, language, confidence, keep)."""
    C.ship(docs.sparkSession)
    names, table = model or train(C.require(docs, "doc_id", "text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast((names, table))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in batches:
            b, c, keep = _classify(batch.column(1), names, table, least)
            lang = pa.array(names, pa.string()).take(pa.array(b, mask=b < 0)) if names else pa.nulls(len(b), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lang, pa.array(c), pa.array(keep)], names=["doc_id", "language", "confidence", "keep"])

    return C.require(docs, "doc_id", "text").mapInArrow(run, "doc_id long, language string, confidence double, keep boolean")


def accepted(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, least: float = MIN_CONFIDENCE) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    C.ship(docs.sparkSession)
    names, table = model or train(C.require(docs, "doc_id", "text", "lang"))
    shared, at = docs.sparkSession.sparkContext.broadcast((names, table)), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in batches:
            yield batch.filter(pa.array(_classify(batch.column(at), names, table, least)[2]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(C.read(spark, sf_dir, "documents"))
