"""Quality classifier from weak labels (operator 8).

Eight heuristic labellers vote good, bad or abstain on every document.  Documents with the same
pattern of votes are alike to the label model, so the patterns of the whole corpus are counted (at
most 3^8 of them, however many documents) and expectation-maximisation on the counts estimates the
prior and, for each labeller that votes, how often it is right about good and how often about bad
documents.  Both are needed: a labeller of symbols is right about nearly all good documents and misses most
bad ones, as those are bad in other ways.  The estimates start from one rule (a document is bad if anybody
says so) and are held back by PRIOR_VOTES imaginary votes only, whatever the size of the corpus.

The posteriors label at most SAMPLE documents on which a hashed linear scorer over character n-grams is
trained; it then scores every document.

Defined cases: a text without a word (null, empty, blank) is bad, with posterior and score 0, and takes no part
in the estimates; very long texts are measured and scored whole; null or repeated ids are scored like others
and aren't trained on if null; where all posteriors agree the scorer falls back on them; a score at the
threshold is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common as C
from tessera.llm import features, linear

SAMPLE, ROUNDS, THRESHOLD = 4000, 100, 0.5
#: Labeller -> (figure, bad from, bad up to, good from, good up to); None where there is no such bound; otherwise it abstains.
LABELLERS = {
    "symbols": ("symbols", 0.06, None, None, 0.02),
    "capitals": ("upper", 0.30, None, None, 0.15),
    "repeated_lines": ("repeated_lines", 0.25, None, None, 0.05),
    "digits": ("digits", 0.20, None, None, 0.05),
    "repeated_words": ("repeated_words", 0.80, None, None, 0.60),
    "word_length": ("word_length", 12.0, 2.5, 3.5, 9.0),
    "stopwords": ("stopwords", None, 0.04, 0.12, None),
    "words": ("words", None, 2.0, 20.0, None),
}
RIPE = 15
#: Imaginary votes of each labeller on good and on bad documents, and how many of them are right.
PRIOR_VOTES, PRIOR_RIGHT = 3.0, 2.0
WORDLESS = -1


def votes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Pattern of the votes of each row in base 3: 0 abstain, 1 bad, 2 good; WORDLESS for a row without a word."""
    m = features.measure(data, off)
    code = np.zeros(len(off) - 1, np.int64)
    for f, over, under, least, most in LABELLERS.values():
        x = m[f]
        no, yes = np.zeros(len(x), bool), np.ones(len(x), bool)
        ripe = m["words"] >= RIPE if f == "stopwords" else yes  # a few words may well hold no stopword
        b = (x >= over if over is not None else no) | (ripe & (x <= under) if under is not None else no)
        g = (x >= least if least is not None else yes) & (x <= most if most is not None else yes)
        code = code * 3 + np.where(b, 1, np.where(g, 2, 0))
    return np.where(m["words"] == 0, WORDLESS, code)


def unpack(codes: np.ndarray) -> np.ndarray:
    n = len(LABELLERS)
    return np.stack([codes // 3 ** (n - 1 - k) % 3 for k in range(n)], 1)


def expectation_maximisation(codes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Posterior of good for each pattern; prior of good; each labeller's share of right votes on good and on bad documents."""
    v = unpack(codes)
    bad, good = v == 1, v == 2
    post = np.where(bad.any(1), 0.1, 0.9)
    prior, on_good, on_bad = 0.5, np.zeros(v.shape[1]), np.zeros(v.shape[1])
    for _ in range(rounds):
        g, b = (post * counts)[:, None], ((1 - post) * counts)[:, None]
        prior = float(np.clip(g.sum() / max(1, counts.sum()), 0.01, 0.99))
        on_good = ((good * g).sum(0) + PRIOR_RIGHT) / (((good | bad) * g).sum(0) + PRIOR_VOTES)
        on_bad = ((bad * b).sum(0) + PRIOR_RIGHT) / (((good | bad) * b).sum(0) + PRIOR_VOTES)
        odds = np.log(prior / (1 - prior)) + good @ np.log(on_good / (1 - on_bad)) + bad @ np.log((1 - on_good) / on_bad)
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        if done:
            break
    return post, prior, on_good, on_bad


def _votes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, d, o in C.pieces(*C.buffers(b.column(0))):
            yield pa.RecordBatch.from_arrays([pa.array(votes(d, o).astype(np.int32))], names=["code"])


def classify(docs: DataFrame, rows: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, posterior, score, keep)."""
    spark = docs.sparkSession
    C.ship(spark)
    base = C.require(docs, "doc_id", "text")
    voted = base.select("text").mapInArrow(_votes, "code int")
    found = voted.groupBy("code").count().collect()  # at most 3^8 rows
    found = [r for r in found if r["code"] != WORDLESS]
    codes, counts = np.array([r["code"] for r in found], np.int64), np.array([r["count"] for r in found], float)
    lookup = np.zeros(3 ** len(LABELLERS) + 1)  # the last for WORDLESS
    if len(found):
        lookup[codes] = expectation_maximisation(codes, counts)[0]
    shared_posterior = spark.sparkContext.broadcast(lookup)

    # the sample is chosen by ids; only its texts are voted on again
    xs, ys = linear.sample(base, None, rows, fold=False, judge=votes)
    y = lookup[np.array(ys, np.int64)] if len(ys) else np.zeros(0)
    table = None
    if len(y) and (y > threshold).any() and (y <= threshold).any():
        table = linear.Model(2, fold=False).fit(xs, np.stack([1 - y, y], 1)).table()
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lookup = shared.value, shared_posterior.value
        for b in batches:
            for i, j, d, o in C.pieces(*C.buffers(b.column(1))):
                code = votes(d, o)
                p = lookup[code]
                score = p
                if table is not None:
                    score = np.where(code == WORDLESS, 0.0, linear.softmax(linear.scores(d, o, table, fold=False)[0])[:, 1])
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j].cast(pa.int64()), pa.array(p), pa.array(score.astype(float)), pa.array(score >= threshold)], names=["doc_id", "posterior", "score", "keep"])

    return base.mapInArrow(run, "doc_id long, posterior double, score double, keep boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(C.read(spark, sf_dir, "documents"))
