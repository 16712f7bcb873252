import random

import numpy as np

from tessera.llm import common as C
from tessera.llm import features
from tessera.llm import quality_rules as Q
from tessera.llm import weak_quality as W


def tail(k, n, p):
    from math import comb

    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_bound_is_exact():
    for n, k in ((10, 0), (50, 3), (400, 7)):
        u = Q.upper_bound(k, n, 0.01)
        assert abs(tail(k, n, u) - 0.01) < 1e-6
    assert Q.upper_bound(5, 5, 0.1) == 1.0 and Q.upper_bound(0, 0, 0.1) == 1.0


def test_incomplete_beta_equals_sums_and_is_quick():
    for n in (1, 7, 60, 400):
        for k in range(0, n, max(1, n // 7)):
            for p in (0.001, 0.05, 0.5, 0.97):
                assert abs(Q.tail(k, n, p) - tail(k, n, p)) < 1e-9
    assert 0.05 < Q.tail(499_000, 10**7, 0.05) < 0.1 and Q.certified(499_000, 10**7, 0.05, 0.08) and not Q.certified(499_000, 10**7, 0.05, 0.05)
    assert Q.certified(0, 59, 0.05, 0.05) and not Q.certified(0, 58, 0.05, 0.05)


def test_sequence_stops_at_the_first_failure():
    none, some = (0,) * 5, (2, 0, 0, 0, 0)
    worst = tuple(len(cs) for _, cs in Q.RULES.values())
    assert Q.certify({none: [100, 0, 400, 0], some: [0, 20, 0, 30]}, 0.05, 0.05) == worst  # nothing good is lost
    assert Q.certify({none: [100, 0, 400, 0], some: [50, 20, 200, 30]}, 0.05, 0.05) == (5, *worst[1:])  # the cutoffs that this level doesn't exceed
    assert Q.certify({none: [9, 9, 40, 9]}, 0.05, 0.05) is None and Q.certify({}, 0.05, 0.05) is None
    assert Q.level({1: {none: [0, 0, 300, 0]}, 2: {none: [0, 0, 40, 0]}}, 0.05, 0.05) == 0.05


def test_risk_is_controlled_on_fresh_documents():
    """Good documents whose figures are known in law: how often does a certified setting reject more than RISK of them?"""
    rnd = np.random.default_rng(4)
    cs = Q.RULES["symbols"][1]
    over, used = 0, 0
    for _ in range(400):
        counts = {}
        for part in (0, 2):
            x = rnd.beta(1, 30, 300 + 200 * part)
            for lv, n in zip(*np.unique(sum((x > c).astype(int) for c in cs), return_counts=True)):
                counts.setdefault((int(lv), 0, 0, 0, 0), [0, 0, 0, 0])[part] += int(n)
        counts.setdefault((7, 0, 0, 0, 0), [0, 0, 0, 0])[1] += 100
        got = Q.certify(counts, 0.05, 0.05)
        used += bool(got and got[0])
        over += bool(got and got[0]) and (1 - cs[got[0] - 1]) ** 30 > 0.05
    assert used > 300 and over <= 400 * 0.05 + 8


def figures_of(text):
    """Each figure of the rules, character by character."""
    raw = (text or "").encode()
    word, words = b"", []
    for c in raw + b" ":
        if c > 32:
            word += bytes([c])
        elif word:
            words.append(word)
            word = b""
    lines = [x for x in (text or "").split("\n") if x]
    seen = max(1, sum(map(len, words)))
    up, low, far = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw), sum(c >= 128 for c in raw)
    again = lambda v: (len(v) - len(set(v))) / max(1, len(v))
    return {
        "symbols": sum(c in b"#$%&*|!@^~<>{}[]\\=+_`" for c in raw) / seen, "upper": up / max(up + low + far / 2, 1), "digits": sum(48 <= c <= 57 for c in raw) / seen, "repeated_lines": again(lines), "repeated_words": again(words),
        "words": float(len(words)), "word_length": sum(map(len, words)) / max(1, len(words)), "stopwords": sum(w.decode("utf-8", "replace") in features.STOPWORDS for w in words) / max(1, len(words)),
    }


def brute_rules(docs, labels, part):
    """The kept documents, document by document, with sums for the bounds."""
    worst = {}
    for i, q in labels:
        if i is not None and q is not None:
            worst[i] = min(worst.get(i, 1), int(q == 1))
    figures = [(i, s, figures_of(t)) for i, t, s in docs]
    trials = {}
    for i, s, f in figures:
        if i in worst:
            old = trials.get((i, s))
            trials[i, s] = {k: max(v, old[k]) if old else v for k, v in f.items()}
    fails = lambda f, cut: [r for r, (k, _) in Q.RULES.items() if cut[r] is not None and f[k] > cut[r]]
    strata = {s for _, s in trials}
    good = {s: [f for (i, t), f in trials.items() if t == s and worst[i] and part[i]] for s in strata}
    m = max((k for k in range(1, len(strata) + 1) if sum(len(g) > 0 and 0.95 ** len(g) <= 0.05 / k for g in good.values()) >= k), default=1)
    cuts = {}
    for s in strata:
        first = [(f, worst[i]) for (i, t), f in trials.items() if t == s and not part[i]]
        at, best = dict.fromkeys(Q.RULES, 0), None
        cut_of = lambda a: {r: cs[a[r] - 1] if a[r] else None for r, (_, cs) in Q.RULES.items()}
        while any(at[r] < len(cs) for r, (_, cs) in Q.RULES.items()):
            left = [(f, g) for f, g in first if not fails(f, cut_of(at))]
            options = []
            for k, (r, (_, cs)) in enumerate(Q.RULES.items()):
                if at[r] < len(cs):
                    new = at | {r: at[r] + 1}
                    gone = [g for f, g in left if fails(f, cut_of(new))]
                    options.append(((gone.count(0) + 0.5) / (gone.count(1) + 0.5), -k, new))
            at = max(options, key=lambda o: o[:2])[2]
            n, k = len(good[s]), sum(bool(fails(f, cut_of(at))) for f in good[s])
            if n == 0 or k >= n or tail(k, n, 0.05) > 0.05 / m:
                break
            best = at
        cuts[s] = cut_of(best or dict.fromkeys(Q.RULES, 0))
    none = dict.fromkeys(Q.RULES)
    return sorted(((i, s, fails(f, cuts.get(s, none))) for i, s, f in figures), key=str)


def test_judgement_equals_brute_force(spark):
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        lang = rnd.choice(["en"] * 6 + ["de"] * 3 + [None])
        w = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 60))]
        q = int(rnd.random() < 0.8)
        if not q or rnd.random() < 0.02:
            w = rnd.choice([["##$%"] * 9 + w[:20], [x.upper() for x in w], ["12345"] * len(w), [w[0]] * 40, ["same line\n"] * 12])
        docs.append((i, " ".join(w), lang))
        labels += [(i, q)] * (1 + i % 2)
    docs += [(5, "a b c", "en"), (6, docs[6][1], docs[6][2]), (None, "## ##", "en"), (2000, None, "en"), (2001, "", None), (2002, "## word " * 20_000, "de")]
    labels += [(None, 1), (7, 0), (8, None), (9999, 1), (2000, 1)]
    part = {r.i: r.p for r in spark.createDataFrame([(i,) for i in {d[0] for d in docs} if i is not None], "i long").selectExpr("i", "pmod(xxhash64(i), 3) > 0 as p").collect()}
    df = spark.createDataFrame([(t, "x", i, s, 0.0) for i, t, s in docs], "text string, stratum string, doc_id long, lang string, symbols double")
    out = Q.judge(df, spark.createDataFrame([(q, i, "t") for i, q in labels], "quality int, doc_id long, text string")).collect()
    want = brute_rules(docs, labels, part)
    assert sorted(((r.doc_id, r.stratum, r.failed) for r in out), key=str) == want and all(r.keep == (not r.failed) for r in out)
    assert sum(bool(f) for _, _, f in want) > 100


def test_rules_on_the_table(spark):
    """Every stratum of this table can be certified; at a tenth of it only English can."""
    d = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in Q.query(spark, d).collect()}
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for s in ("en", "de", "fr", "es"):
        good, bad = ([out[i].keep for i, q in lab.items() if q == k and out[i].stratum == s] for k in (1, 0))
        assert np.mean(good) >= 1 - Q.RISK and np.mean(bad) < 0.1, s
    small = Q.query(spark, "/root/testdata/sf0.01").groupBy("stratum").agg({"keep": "min"}).collect()
    assert {r[0]: r[1] for r in small} == {"en": False, "de": True, "fr": True, "es": True}


ROWS = [(None, "x", None, "s"), ("", "x", 1, "s"), ("plain words in a row", None, 2, "s"), ("$$$ %%% ###", "x", None, "s"), ("w " * 100000, "x", 3, "s"), ("same text here", "x", 4, "s"), ("same text here", "x", 4, "s")]


def test_rule_cases(spark):
    df = spark.createDataFrame(ROWS, "text string, lang string, doc_id long, stratum string")
    labels = spark.createDataFrame([(1, 1, 0, "a"), (None, 1, 0, "b"), (99, 1, 0, "c"), (2, None, None, None)], "doc_id long, quality int, toxic int, text string")
    out = Q.judge(df, labels).collect()
    assert len(out) == len(ROWS) and all(r.keep and r.failed == [] for r in out)
    assert Q.judge(df.limit(0), labels).collect() == [] and len(Q.judge(df, labels.limit(0)).collect()) == len(ROWS)
    many = spark.createDataFrame([("good words " + str(i), None, i, "s") for i in range(3000)] + [("$$$$ " * 9, None, 9000, "s")], df.schema)
    out = {r.doc_id: r for r in Q.judge(many, spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id long, quality int")).collect()}
    assert out[9000].failed == ["symbols", "repeated_words"]
    assert all(out[i].keep for i in range(3000))


def test_label_model_finds_accuracies():
    rnd = np.random.default_rng(0)
    y = rnd.random(40000) < 0.8
    on_good, on_bad = np.array([0.99, 0.97, 0.95, 0.99, 0.98, 0.9, 0.97, 0.99]), np.array([0.7, 0.5, 0.3, 0.2, 0.6, 0.8, 0.4, 0.6])
    right = rnd.random((len(y), 8)) < np.where(y[:, None], on_good, on_bad)
    vote = np.where(rnd.random((len(y), 8)) < 0.8, np.where(right == y[:, None], 2, 1), 0)
    code = sum(vote[:, k] * 3 ** (7 - k) for k in range(8))
    codes, inv, n = np.unique(code, return_inverse=True, return_counts=True)
    post, prior, good, bad = W.expectation_maximisation(codes, n.astype(float))
    assert (W.unpack(codes)[inv] == vote).all()
    assert abs(prior - 0.8) < 0.03 and np.abs(good - on_good).max() < 0.02 and np.abs(bad - on_bad).max() < 0.06 and ((post[inv] > 0.5) == y).mean() > 0.95


def brute_posteriors(texts):
    """Votes from the figures of each text and the estimates document by document."""
    votes = []
    for t in texts:
        f, row = figures_of(t), []
        for figure, over, under, least, most in W.LABELLERS.values():
            x = f[figure]
            if (over is not None and x >= over) or (under is not None and x <= under and (figure != "stopwords" or f["words"] >= W.RIPE)):
                row.append(1)
            else:
                row.append(2 if (least is None or x >= least) and (most is None or x <= most) else 0)
        votes.append(row if f["words"] else None)
    known = [v for v in votes if v]
    post = [0.1 if 1 in v else 0.9 for v in known]
    for _ in range(W.ROUNDS):
        prior = min(max(sum(post) / len(post), 0.01), 0.99)
        rate = lambda k, right, weights: (sum(w for v, w in zip(known, weights) if v[k] == right) + W.PRIOR_RIGHT) / (sum(w for v, w in zip(known, weights) if v[k]) + W.PRIOR_VOTES)
        a, b = [rate(k, 2, post) for k in range(8)], [rate(k, 1, [1 - p for p in post]) for k in range(8)]
        new = []
        for v in known:
            z = prior / (1 - prior)
            for k, x in enumerate(v):
                z *= a[k] / (1 - b[k]) if x == 2 else (1 - a[k]) / b[k] if x == 1 else 1
            new.append(z / (1 + z))
        done = max(abs(p - q) for p, q in zip(new, post)) < 1e-9
        post = new
        if done:
            break
    it = iter(post)
    return [next(it) if v else 0.0 for v in votes]


def test_posteriors_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(None, None), (5000, ""), (5001, " \n "), (5002, "$$ ## " * 30), (5003, "word")]
    want = brute_posteriors([t for _, t in rows])
    out = {r.doc_id: r for r in W.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(out) == len(rows) and all(abs(out[i].posterior - p) < 1e-6 for (i, _), p in zip(rows, want))
    assert all(out[i].score == 0 and not out[i].keep for i in (None, 5000, 5001))
    assert np.mean([(out[i].posterior >= 0.5) == out[i].keep for i, _ in rows]) > 0.97  # the scorer has learned them


def test_the_labellers_themselves_against_labels():
    """Figures of real documents: each labeller's rates are estimated without labels and held against them."""
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.1"
    lab = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{d}/labels.parquet").to_pylist()}
    table = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"])
    code = W.votes(*C.buffers(table["text"]))
    codes, inv, n = np.unique(code, return_inverse=True, return_counts=True)
    post, prior, on_good, on_bad = W.expectation_maximisation(codes, n.astype(float))
    y = np.array([lab.get(i, -1) for i in table["doc_id"].to_pylist()])
    v, kept = W.unpack(code), post[inv] >= 0.5
    assert kept[y == 1].mean() > 0.99 and kept[y == 0].mean() < 0.3 and abs(prior - (y == 1).sum() / (y >= 0).sum()) < 0.06
    for k in range(8):
        voted = v[:, k] > 0
        assert abs((v[voted & (y == 1), k] == 2).mean() - on_good[k]) < 0.05 and abs((v[voted & (y == 0), k] == 1).mean() - on_bad[k]) < 0.25


def test_classifier_against_labels(spark):
    d = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in W.query(spark, d).collect()}
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(out) == 10000
    assert np.mean([out[i].keep for i, q in lab.items() if q == 1]) > 0.99 and np.mean([out[i].keep for i, q in lab.items() if q == 0]) < 0.35


def test_classifier_cases(spark):
    df = spark.createDataFrame(ROWS, "text string, lang string, doc_id long, score string")
    assert len(W.classify(df).collect()) == len(ROWS)
    assert W.classify(df.limit(0)).collect() == []
    rnd = random.Random(0)
    many = [("the house of the man and the " + " ".join(rnd.choice("abcdef") * 4 for _ in range(20)), "x", i, "s") for i in range(60)] + [("$%& ## " * 12, "x", 100 + i, "s") for i in range(20)]
    out = W.classify(spark.createDataFrame(many, df.schema)).collect()
    assert {r.keep for r in out if r.doc_id < 60} == {True} and {r.keep for r in out if r.doc_id >= 100} == {False}
