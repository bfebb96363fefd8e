import hashlib
import random
from collections import Counter

import numpy as np

from alertflow.llm import suffix_dedup as S


def brute(rows):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[i:i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for (doc_id, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i:i + 200]] > 1:
                gone[i:i + 200] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_removals_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 701)  # long texts are handled in several stretches
    rng = random.Random(4)

    def text(n):
        return "".join(rng.choice("abcdefgh ijkl\n") for _ in range(n))

    passage, near = text(260), text(199)
    rows = [(1, passage), (2, text(90) + passage + text(90)), (3, text(50) + passage[:210] + text(70)), (4, near + text(300)),
            (5, text(300) + near), (6, text(199)), (7, None), (8, ""), (9, "é" * 250), (10, "ab" * 400), (11, "x" * 199),
            (12, passage[30:] + text(5) + passage[:229]), (13, text(1900) + passage + text(1900)), (None, passage[1:240]),
            (14, "same text " * 25), (14, "same text " * 25)]
    base = text(1200)
    for i in range(30):  # copies with one edit each: every edit leaves its surroundings unique
        p = rng.randrange(1200)
        rows.append((100 + i, base[:p] + "#" + str(i) + base[p:]))
    rows += [(200 + i, text(rng.randint(1, 300)) + passage[20:200] + text(200)) for i in range(20)]  # 180 shared bytes: too few
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lo string")
    for least in (S.LEAST_RUNS, 20):  # one bucket; as many as the session has
        monkeypatch.setattr(S, "LEAST_RUNS", least)
        got = [tuple(r)[:5] for r in S.remove_repeats(df).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    monkeypatch.setattr(S, "RUNS_PER_BUCKET", 50)  # more buckets than the session has, many ends within one passage
    got = [tuple(r)[:5] for r in S.remove_repeats(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    assert S.remove_repeats(spark.createDataFrame([], df.schema)).collect() == []


def test_rows_keep_their_numbers_when_files_are_split_otherwise(spark, monkeypatch, tmp_path):
    rng = random.Random(8)

    def text(n):
        return "".join(rng.choice("abcdefgh ijkl") for _ in range(n))

    passage = text(300)
    rows = [(i, text(rng.randint(100, 400)) + (passage[:rng.randint(210, 300)] if i % 3 else "") + text(100)) for i in range(60)]
    path, size = str(tmp_path / "docs"), "spark.sql.files.maxPartitionBytes"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(path)
    before, staged, calls = spark.conf.get(size), S.staged, []

    def then_other_splits(df, tag):
        out = staged(df, tag)
        calls.append(tag)
        spark.conf.set(size, ["1500b", "128m"][len(calls) % 2])
        return out

    monkeypatch.setattr(S, "staged", then_other_splits)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [tuple(r)[:5] for r in S.remove_repeats(spark.read.parquet(path)).collect()]
    finally:
        spark.conf.set(size, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def test_multikey_order():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 500, 30_000):
        tokens = [rng.integers(0, 4, n), rng.integers(0, 3, n), rng.integers(0, 2, n)]
        order = S.multikey_order(tokens)
        rows = list(zip(*(t[order].tolist() for t in tokens), strict=True))
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(n))


def test_splitters_deal_in_key_order():
    rng = np.random.default_rng(3)
    key = [rng.integers(-2, 3, 4000) for _ in range(3)]
    rows = list(zip(*(k.tolist() for k in key), strict=True))
    cuts = sorted(rows[:40])  # with repeated ones
    got = S.bucket_of(key, [np.array(c) for c in zip(*cuts, strict=True)])
    assert got.tolist() == [sum(c <= r for c in cuts) for r in rows]


def test_leading_bytes_are_ordered_as_text():
    texts = sorted("zürich Aachen\x00 ~~~ ÿÿ 日本語の文 abc".encode()[i:i + 8] for i in range(30))
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = S.leading(data, np.arange(len(texts)) * 8).tolist()
    assert got == sorted(got) and len(set(got)) == len(set(texts))


def test_equal_strings_choose_equal_anchors():
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 105, 450).astype(np.uint8)
    places = []
    for k in (0, 37, 333):
        data = np.concatenate([rng.integers(97, 105, k).astype(np.uint8), shared, rng.integers(97, 105, 100).astype(np.uint8)])
        of_start = {}
        for lo, hi, a, *_ in S.first_runs(data):
            for x, y, z in zip(lo, hi, a, strict=True):
                of_start |= {int(s) - k: int(z) - k for s in range(x, y + 1)}
        places.append([of_start[s] for s in range(251)])
    assert places[0] == places[1] == places[2]
