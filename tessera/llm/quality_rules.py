"""Quality rules with risk-controlled cutoffs (operator 5).

Each rule rejects a document whose figure exceeds a cutoff from a fixed grid.  Cutoffs are chosen for every
stratum (language) from labelled documents, so that all rules together reject at most RISK of the good
documents of the stratum, with probability 1 - DELTA over the labels for all strata at once.

A third of a stratum's labelled documents proposes, the rest certifies.  On the first part a path is laid from
no rule at all to all rules at their strictest: at each step the rule is tightened by one cutoff that rejects
the most additional bad documents for each additional good one.  On the second part the path's settings are
tested in their order: a setting is certified if the exact binomial (Clopper-Pearson) upper bound on the share
of good documents that any of its rules rejects is at most RISK; the first failure ends the sequence.  The
order is fixed before the second part is looked at, so the whole sequence is one test at its level.  The budget
DELTA is shared equally (Bonferroni) among the strata that hold enough good documents to certify anything:
with n of them and no rejection the bound is at most RISK if (1 - RISK)^n <= the level, which is 59 good
documents for one stratum and 86 each for four.  A stratum with fewer has no certified cutoff and no rule
rejects its documents: that is all that its labels can support.

The figures of labelled documents are reduced to the number of the mildest cutoff that each rule's figure
exceeds and counted, on the executors, in at most 8,400 kinds for each stratum, part and label; only the
counts reach the driver, however many labels there are.

Defined cases: a null stratum is one of its own; documents with null or empty texts have figures of 0
and pass; very long texts are measured whole; a figure equal to a cutoff passes; ties between rules on the
path go to the first in the order of RULES; labels other than quality = 1 count as bad, null ones not at all; a
document counts once as a trial: of labels that repeat an id the worst counts, of rows that repeat one each
rule's greatest figure (near copies under other ids are trials of their own, so labels should be drawn from
deduplicated documents); labels without a document or with a null id are ignored; with no labels nothing is
rejected; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import features

RISK, DELTA = 0.05, 0.05
#: Rule -> (figure, cutoffs from mild to strict); a document above the cutoff fails.
RULES = {
    "symbols": ("symbols", (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.06)),
    "capitals": ("upper", (0.95, 0.8, 0.6, 0.4, 0.3, 0.2)),
    "repeated_lines": ("repeated_lines", (0.9, 0.7, 0.5, 0.35, 0.25)),
    "digits": ("digits", (0.8, 0.5, 0.3, 0.2)),
    "repeated_words": ("repeated_words", (0.98, 0.95, 0.9, 0.85)),
}
_COLS = sorted({f for f, _ in RULES.values()})
#: Counts of one stratum: (levels of all rules) -> (good, bad) documents of the first and of the second part.
Histogram = dict[tuple[int, ...], list[int]]


# ---------------------------------------------------------------- bounds

def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz); some sqrt(max(a, b)) terms."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 10_000_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + t / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    return 1.0 if k >= n else incomplete_beta(n - k, k + 1, 1 - p)


def upper_bound(rejected: int, n: int, delta: float) -> float:
    """Clopper-Pearson upper confidence bound on a binomial share."""
    if n == 0 or rejected >= n:
        return 1.0
    lo, hi = rejected / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(rejected, n, mid) > delta else (lo, mid)
    return hi


def certified(rejected: int, n: int, risk: float, delta: float) -> bool:
    """Whether the upper bound is at most the risk; one evaluation, without finding the bound."""
    return n > 0 and rejected < n and tail(rejected, n, risk) <= delta


# ---------------------------------------------------------------- paths

def rejects(levels: tuple[int, ...], setting: tuple[int, ...]) -> bool:
    """levels: the number of cutoffs of each rule that the figure exceeds, counted from the strictest; setting: how many cutoffs of each rule are in use, from the mildest."""
    return any(s and lv > len(cs) - s for lv, s, (_, cs) in zip(levels, setting, RULES.values()))


def path(counts: Histogram) -> list[tuple[int, ...]]:
    """Settings from no rule to the strictest, each one cutoff stricter; best trade of bad for good documents first."""
    grid = [len(cs) for _, cs in RULES.values()]
    at, out = tuple(0 for _ in grid), []
    left = {lv: (n[0], n[1]) for lv, n in counts.items() if n[0] or n[1]}
    while any(a < g for a, g in zip(at, grid)):
        best = None
        for r, g in enumerate(grid):
            if at[r] < g:
                new = at[:r] + (at[r] + 1,) + at[r + 1 :]
                gone = [n for lv, n in left.items() if lv[r] > g - new[r]]
                good, bad = sum(n[0] for n in gone), sum(n[1] for n in gone)
                score = ((bad + 0.5) / (good + 0.5), -r)
                if best is None or score > best[0]:
                    best = (score, new)
        at = best[1]
        left = {lv: n for lv, n in left.items() if not rejects(lv, at)}
        out.append(at)
    return out


def certify(counts: Histogram, risk: float, delta: float) -> tuple[int, ...] | None:
    """The last setting of the path that the sequence of tests reaches."""
    good = {lv: n[2] for lv, n in counts.items() if n[2]}
    n, best = sum(good.values()), None
    for setting in path(counts):
        if not certified(sum(c for lv, c in good.items() if rejects(lv, setting)), n, risk, delta):
            break
        best = setting
    return best


def level(strata: dict, risk: float, delta: float) -> float:
    """The share of delta of each stratum: equal among those that hold enough good documents for it."""
    sizes = sorted((sum(c[2] for c in h.values()) for h in strata.values()), reverse=True)
    k = 0
    while k < len(sizes) and sizes[k] and (1 - risk) ** sizes[k] <= delta / (k + 1):
        k += 1
    return delta / max(k, 1)


# ---------------------------------------------------------------- tables

def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, d, o in C.pieces(*C.buffers(b.column(1))):
            m = features.measure(d, o)
            yield pa.RecordBatch.from_arrays([b.column(0)[i:j].cast(pa.int64()), b.column(2)[i:j], *(pa.array(m[c]) for c in _COLS)], names=["doc_id", "stratum", *_COLS])


def histograms(figures: DataFrame, labels: DataFrame) -> dict[str | None, Histogram]:
    """The counts of every stratum."""
    label = labels.where(labels["doc_id"].isNotNull() & labels["quality"].isNotNull()).groupBy(labels["doc_id"].alias("label_id")).agg(F.min((labels["quality"] == 1).cast("int")).alias("good"))
    exceeded = [sum(((F.col(f) > c).cast("int") for c in cs[1:]), (F.col(f) > cs[0]).cast("int")).alias(f"level_{r}") for r, (f, cs) in RULES.items()]
    names = [f"level_{r}" for r in RULES]
    own = figures.join(label, figures["doc_id"] == F.col("label_id")).select("doc_id", "stratum", "good", *exceeded)
    trials = own.groupBy("doc_id", "stratum", "good").agg(*[F.max(n).alias(n) for n in names])
    second = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).cast("int")
    kinds = trials.groupBy("stratum", "good", second.alias("second"), *names).agg(F.count("*").alias("n"))
    out: dict[str | None, Histogram] = defaultdict(dict)
    for r in kinds.toLocalIterator():
        out[r["stratum"]].setdefault(tuple(r[n] for n in names), [0, 0, 0, 0])[2 * r["second"] + 1 - r["good"]] += r["n"]
    return dict(out)


def cutoffs(figures: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> list[tuple]:
    """(stratum, rule, cutoff or None) for every stratum of the labelled documents."""
    strata = histograms(figures, labels)
    share = level(strata, risk, delta)
    out = []
    for s, counts in strata.items():
        setting = certify(counts, risk, share) or (0,) * len(RULES)
        out += [(s, r, cs[k - 1] if k else None) for k, (r, (_, cs)) in zip(setting, RULES.items())]
    return out


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(doc_id, stratum, keep, failed): failed holds the names of the rules that reject the document."""
    spark = docs.sparkSession
    C.ship(spark)
    figures = C.checkpointed(C.require(docs, "doc_id", "text", "lang").mapInArrow(_measure, "doc_id long, stratum string, " + ", ".join(f"{c} double" for c in _COLS)))
    found = cutoffs(figures, C.require(labels, "doc_id", "quality"), risk, delta)
    strata = {s for s, _, _ in found}
    cut = {(s, r): c for s, r, c in found}
    table = spark.createDataFrame([(s, *[cut[s, r] for r in RULES]) for s in strata], "cut_stratum string, " + ", ".join(f"cut_{r} double" for r in RULES))
    joined = figures.join(table, figures["stratum"].eqNullSafe(table["cut_stratum"]), "left")  # a row for each stratum
    failed = F.filter(F.array(*[F.when(F.col(f) > F.col(f"cut_{r}"), F.lit(r)) for r, (f, _) in RULES.items()]), lambda x: x.isNotNull())
    return joined.select("doc_id", "stratum", failed.alias("failed")).select("doc_id", "stratum", (F.size("failed") == 0).alias("keep"), "failed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))
