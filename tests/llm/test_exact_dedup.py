import hashlib
import random

import pyspark.sql.functions as F

from alertflow.llm import exact_dedup as E

SPACES = str.maketrans("", "", " \t\n\x0b\x0c\r")


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) of rows (doc_id, text), one kept per group."""
    groups = {}
    for n, (doc_id, text) in enumerate(rows):
        groups.setdefault((text or "").translate(SPACES), []).append((-len(text or ""), doc_id is None, doc_id or 0, n, doc_id))
    out = []
    for norm, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m is best, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return out


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "gamma", "eky", "opus", "ux"]) for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab"), (6, "a  b"), (7, "a\u00a0b"), (8, "A b"), (9, long),
            (10, long.replace(" ", "\n")), (11, long + "x"), (12, long.replace(" ", "  ", 3)), (13, "\U0001f600 é"),
            (14, "\U0001f600é"), (None, "ab"), (None, "nul"), (4, "a b"), (15, long[:200_000] + "!" + long[200_000:])]
    rows += [(100 + i, "copy " * (i % 3 + 1)) for i in range(60)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, recipe string")
    got = [tuple(r) for r in E.exact_groups(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    kept = E.drop_copies(df)
    assert kept.columns == df.columns
    want = sorted(repr(r[0]) for r in brute(rows) if r[3])
    assert sorted(repr(r.doc_id) for r in kept.collect()) == want
    empty = spark.createDataFrame([], df.schema)
    assert E.exact_groups(empty).collect() == [] and E.drop_copies(empty).collect() == []


def test_chunks_are_the_text_and_follow_its_content(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    rows = [(text,), ("new beginning" + text,), ("x" * 20_000,), ("",)]
    cut = [r.c for r in spark.createDataFrame(rows, "t string").select(E.chunks(F.col("t")).alias("c")).collect()]
    assert ["".join(c) for c in cut] == [r[0] for r in rows]
    assert all(len(p) <= E.MAX for c in cut for p in c)
    assert len(set(cut[0]) & set(cut[1])) > 0.8 * len(cut[0])


def test_a_key_with_two_contents_gets_two_identifiers(spark, monkeypatch):
    monkeypatch.setattr(E.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [(1, "one text"), (2, "another"), (3, "onetext")]
    got = {r.doc_id: r.keep_id for r in E.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_only_dataframe_functions(spark):
    plan = E.op10_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_drop_copies_keeps_the_callers_columns_and_moves_only_copies(spark):
    rows = [(1, "a b"), (1, "a  b"), (1, "a b"), (2, "ab"), (3, "other"), (3, "other"), (None, "x"), (None, "x"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "'k' AS copy_key", "'n' AS copy_n", "'K' AS __key", "'g' AS group_size", "'e' AS kept")
    kept = E.drop_copies(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, "a  b"), (3, "other"), (None, "x"), (4, None)], key=repr)
    assert {(r.copy_key, r.copy_n, r["__key"], r.group_size, r.kept) for r in got} == {("k", "n", "K", "g", "e")}
    plain = E.drop_copies(spark.createDataFrame([(i, f"text {i % 50}") for i in range(60)], "doc_id long, text string"))
    assert plain.count() == 50 and "Window" not in plain._jdf.queryExecution().optimizedPlan().toString()
