import math

import duckdb
import pandas as pd

from tessera.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, src string, share int, key int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 1, "clash", 1, 2) for d, t, s in rows], SCHEMA)


def test_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    documents = pd.read_parquet(f"{d}/documents.parquet")  # noqa: F841
    want = {r[0]: r[2] for r in duckdb.sql(mixing.SQL).fetchall()}
    got = {r.doc_id: r.copies for r in mixing.query(spark, d).collect()}
    assert got == want and sum(got.values()) == len(got)


def test_fixed_size_whole_copies_and_unequal_odds(spark):
    rows = [(i, "x" * (1 + 40 * (i % 50)), "s") for i in range(2000)]
    df = frame(spark, rows)
    sizes = {i: math.isqrt(len(t)) + 1 for i, t, _ in rows}
    total = sum(sizes.values())
    for n in (300, 2000, 5001):
        got = {r.doc_id: r.copies for r in mixing.copies(df, total=n).collect()}
        assert sum(got.values()) == n
        assert all(math.floor(n * sizes[i] / total) <= c <= math.floor(n * sizes[i] / total) + 1 for i, c in got.items())
    got = {r.doc_id: r.copies for r in mixing.copies(df, total=600).collect()}
    large = sum(c for i, c in got.items() if i % 50 >= 25) / 600
    assert abs(large - sum(s for i, s in sizes.items() if i % 50 >= 25) / total) < 0.06


def test_weights_and_cases(spark):
    rows = [(i, "t" * i, "ab"[i % 2]) for i in range(100)] + [(500, None, None), (501, "", None), (None, "z", "a"), (7, "same", "c"), (7, "same", "c")]
    df = frame(spark, rows)
    out = mixing.mix(df, weights={"a": 3, "b": 1, "c": 0}, total=80)
    assert out.columns == df.columns
    by = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert by == {"a": 60, "b": 20}
    assert mixing.copies(df).count() == len(rows)
    got = mixing.copies(df).collect()  # ties are broken, so that the size is fixed
    assert sum(r.copies for r in got) == len(rows) and max(r.copies for r in got if r.source == "c") - min(r.copies for r in got if r.source == "c") <= 1
    assert mixing.copies(df.limit(0)).collect() == [] and mixing.mix(df.limit(0)).collect() == []
    assert mixing.mix(df, weights={}).count() == 0


def sql_copies(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(con.execute(mixing.SQL).fetchall(), key=str)


def test_the_size_is_fixed_whatever_repeats(spark):
    same = [(1, "same text", "s")] * 100
    nulls = [(None, "t" * (i % 3), "n") for i in range(90)] + [(None, None, None)] * 30
    others = [(i, "x" * (i * 7 % 90), "o") for i in range(60)] + [(2000, "w " * 200_000, "o")]
    for rows in (same, nulls, same + nulls + others):
        df = frame(spark, rows).repartition(3)
        for total in (0, 31, 333):
            got = mixing.copies(df, total=total).collect()
            assert len(got) == len(rows) and sum(r.copies for r in got) == total
        assert mixing.mix(df, total=31).count() == 31
        assert sorted(((r.doc_id, r.source, r.copies) for r in mixing.copies(df).collect()), key=str) == sql_copies(rows)


def test_shares_are_exact_for_very_large_totals(spark):
    df = frame(spark, [(i, "t" * i, "ab"[i % 2]) for i in range(50)])
    got = mixing.copies(df, weights={"a": 0.999999, "b": 0.000001}, total=10**12 + 1).collect()
    assert sum(r.copies for r in got) == 10**12 + 1
    assert sum(r.copies for r in got if r.source == "b") in (10**6, 10**6 + 1)


def test_a_null_source_has_its_own_weight(spark):
    df = frame(spark, [(i, "t", None if i % 2 else "") for i in range(40)])
    count = lambda w: {r.source: r["count"] for r in mixing.mix(df, weights=w, total=40).groupBy("source").count().collect()}
    assert count({"": 1}) == {"": 40} and count({None: 1}) == {None: 40} and count({None: 3, "": 1}) == {None: 30, "": 10}
