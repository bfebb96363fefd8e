import duckdb
import pytest

import corpus_pipeline
from alertflow.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def brute_targets(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2.0) -> dict:
    """Share out by weight, stop at the cap, share the excess again, until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, got = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not over:
            got |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            got[s] = cap * sizes[s]
            open_.remove(s)
        left -= sum(got[s] for s in over)
    return got


def check(rows, docs):
    sizes, size_of = {}, {}
    for doc_id, text, source, _ in docs:
        n = len((text or "").encode().split())
        sizes[source] = sizes.get(source, 0) + n
        size_of.setdefault((doc_id, source), n)
    want = brute_targets(sizes)
    taken, largest = {}, {}
    source_of = {(d[0], len((d[1] or "").encode().split())): d[2] for d in docs}
    for r in rows:
        s = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest[s] + 1e-6
    return want


def test_targets_and_taken_words(spark):
    docs = [(i, "w " * (1 + i * 7 % 40), "src" + str(i % 7 if i % 3 else 0), "x") for i in range(900)]
    rows = mixing.mix(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(rows) == 900
    want = check(rows, docs)
    assert all(t > 0 for t in want.values())


def test_small_source_stops_at_its_cap(spark):
    docs = [(i, "w " * 10, "a" if i < 5 else "b" if i < 300 else "c", "x") for i in range(600)]
    want = check(mixing.mix(spark.createDataFrame(docs, SCHEMA)).collect(), docs)
    assert want["a"] == 100  # 2 * 50 words


def test_nulls_repeats_and_empty(spark):
    docs = [(None, "a b c", None, "x"), (1, None, "s", "x"), (1, None, "s", "x"), (2, "", None, "x"),
            (3, "only", "t", "x"), (3, "only", "t", "x")]
    rows = mixing.mix(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(rows) == 6 and sum(r.size for r in rows) == 5
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.apply_mix(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "text", "source", "size"]


def test_apply_mix_repeats_rows_as_planned(spark):
    docs = [(i, "w " * (1 + i % 9), f"s{i % 4}", "clash") for i in range(400)]
    df = spark.createDataFrame(docs, SCHEMA)
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    got = {}
    for r in mixing.apply_mix(df).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r.size == "clash"
    assert got == {d: c for d, c in copies.items() if c}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    rows = mixing.op4_mixing(spark, d).collect()
    want = con.execute(mixing.ORACLE).fetchall()
    assert sorted(map(tuple, rows)) == sorted(want)
    docs = con.execute("SELECT doc_id, text, source, '' FROM documents").fetchall()
    check(rows, docs)
    assert corpus_pipeline.STAGES[3][1](spark, spark.read.parquet(f"{d}/documents.parquet"), d).count() > 0


def test_no_document_comes_out_more_often_than_the_cap(spark):
    """Thirty small sources at their cap and one large, each with wordless rows; columns named like the operator's own."""
    docs = [(1000 * s + i, "" if i % 3 == 0 else "two words", f"small{s:02d}", "keep") for s in range(30) for i in range(12)]
    docs += [(100_000 + i, None if i % 50 == 0 else "w " * 20, "big", "keep") for i in range(400)]
    docs += [(200_000 + i, "", "wordless", "keep") for i in range(5)]
    df = spark.createDataFrame(docs, SCHEMA)
    rows = mixing.mix(df).collect()
    check(rows, docs)
    assert max(r.copies for r in rows) == 2 and all(r.taken <= 2 * r.size for r in rows)
    clash = df.selectExpr("*", "size AS mix_key", "size AS MIX_PLAN", "size AS __mix", "size AS h", "size AS skey", "size AS base")
    out = mixing.apply_mix(clash)
    assert out.columns == clash.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert {r.mix_key, r.MIX_PLAN, r["__mix"], r.h, r.skey, r.base} == {"keep"}
    assert got == {r.doc_id: r.copies for r in rows if r.copies}
