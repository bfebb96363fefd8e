"""Quality rules, toxicity and language identification."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from alertflow.llm import language_id as L
from alertflow.llm import quality as Q
from alertflow.llm import toxicity as T

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 2000 else None
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, inside and len(inside) or 0


def test_base_metrics_equal_brute_force():
    rng = random.Random(2)
    texts = [None, "", "a", "a b c", "a a a a", "x y z x y z", "a\u00a0b c\x1cd", "l\nl\n \n \nl \nl", "#*$%&|<> \U0001f600"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "dd\t", "#", "\x0b", "é"]) for _ in range(rng.randint(1, 300))) for _ in range(200)]
    for t in texts:
        assert Q.base_metrics(t) == brute_base(t), repr(t)


def test_threshold_is_the_middle_of_the_best_gap():
    bad, good = np.zeros(Q._BINS, int), np.zeros(Q._BINS, int)
    bad[100:200], good[300:400] = 1, 1
    assert Q.best_threshold(bad, good) == pytest.approx(Q._LOW + (200 + 300) / 200)
    assert Q.best_threshold(bad * 0, good) == float("-inf") and Q.best_threshold(bad, good * 0) == float("-inf")


def test_quality_on_labelled_documents(spark):
    rows = {r.doc_id: r for r in Q.op6_quality_rules(spark, SF).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    wrong = []
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        got = rows[r.doc_id]
        if not got.base_failed and got.kept != (r.quality == 1):
            wrong.append(r.doc_id)
    assert len(wrong) <= 2
    for i, (doc_id, d) in enumerate(docs.items()):
        got = rows[doc_id]
        assert got.base_failed == (got.n_words < 50 or 100 * got.n_repeat_words > 50 * got.n_words)
        if i % 10 == 0 and len(d.text) < 10_000:
            assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == brute_base(d.text)


def _grams(text):
    b = (text or "").encode()
    return [(int.from_bytes(b[i:i + 4], "little") * 2654435761 % 2**32) >> (32 - Q.BITS) for i in range(len(b) - 3)]


def test_quality_score_and_threshold_equal_a_plain_version(spark):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"] if i % 2 else ["spam", "win", "click", "now", "beta"])
                         + str(rng.randint(0, 30)) for _ in range(rng.randint(5, 120))) for i in range(60)}
    texts |= {60: None, 61: "", 62: "abc", 63: texts[1], 64: "😀é" * 500}
    labels = [(i, i % 2) for i in range(0, 50)] + [(3, 1), (60, 1), (61, 0), (70, 1), (None, 1), (7, None)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    raw, target = Counter(), Counter()
    known = {i: label for i, label in labels if i in texts and label is not None}
    for i, text in texts.items():
        raw.update(_grams(text))
        if known.get(i) == 1:
            target.update(_grams(text))
    n, m = sum(raw.values()), sum(target.values())

    def plain(text):
        cells = _grams(text)
        each = [math.log((target[c] + 0.5) / (m + 0.5 * Q.CELLS)) - math.log((raw[c] + 0.5) / (n + 0.5 * Q.CELLS)) for c in cells]
        return sum(each) / len(each) if each else 0.0

    def passes_base(text):
        words, *_, repeats = brute_base(text)
        return words >= 50 and 100 * repeats <= 50 * words

    # the cost of a cut below bin c, for every cut
    bins = {i: math.floor((plain(texts[i]) + 10) * 100) for i in known if passes_base(texts[i])}
    bad, good = [b for i, b in bins.items() if known[i] == 0], [b for i, b in bins.items() if known[i] == 1]
    assert bad and good

    def cost(cut):
        return sum(b >= cut for b in bad) / len(bad) + Q.TRUSTED_COST * sum(b < cut for b in good) / len(good)

    least = min(cost(c) for c in range(Q._BINS + 1))
    assert cost(math.ceil(round((model.threshold + 10) * 100, 6))) == pytest.approx(least)
    got = {r.doc_id: r for r in Q.judge(docs, model).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        assert got[i].score == pytest.approx(plain(text), abs=1e-9)
        assert got[i].kept == (passes_base(text) and plain(text) >= model.threshold)


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(None, None, "c"), (1, "", "c"), (2, "word " * 60_000, "c"), (2, "w", "c")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = Q.judge(docs, Q.fit(docs, labels)).collect()
    assert sorted(r.n_words for r in got) == [0, 0, 1, 60_000] and not any(r.kept for r in got)
    none = docs.limit(0)
    assert Q.judge(none, Q.fit(none, labels.limit(0))).collect() == []


def test_maximal_segments_equal_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        s = np.array([rng.choice([-3, -1, -1, 2, 3]) for _ in range(rng.randint(1, 30))], float)

        def brute(lo, hi):
            best = max(((s[i:j].sum(), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            return [*brute(lo, best[2]), best[0], *brute(best[3], hi)]

        got = [w for *_, w in sorted(T.maximal_segments(s, np.flatnonzero(s > 0)))]
        assert sorted(got) == sorted(brute(0, len(s)))


def test_toxicity_on_held_out_labels(spark):
    rows = {r.doc_id: r for r in T.op7_toxicity(spark, SF).collect()}
    hit = [0, 0, 0, 0]
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        got = rows[r.doc_id]
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and got.predicted == (got.score >= 0.5)
        if got.held_out:
            hit[2 * r.toxic + got.predicted] += 1
    assert hit[1] == 0 and hit[3] > hit[2]


def test_toxicity_edge_rows(spark):
    clean = [(i, f"the quiet river number {i} runs slowly past the mill", "x") for i in range(80)]
    toxic = [(100 + i, f"the quiet river number {i} you vile oaf runs past", "x") for i in range(30)]
    odd = [(None, "vile oaf", "x"), (300, None, "x"), (301, "", "x"), (302, "far " * 50_000 + "vile oaf", "x"), (100, "calm", "x")]
    docs = spark.createDataFrame(clean + toxic + odd, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d[0], int(d[0] >= 100)) for d in clean + toxic] + [(None, 1), (5, None), (777, 1), (3, 0)],
                                   "doc_id long, toxic int")
    model = T.fit(docs, labels)
    got = T.score(docs, model).collect()
    flagged = [r.doc_id for r in got if r.predicted]
    assert {100 + i for i in range(30)} <= set(flagged) and not any(d is not None and d < 100 for d in flagged)
    assert None in flagged and 302 in flagged and not {300, 301} & set(flagged)
    place = next(r.passages for r in got if r.doc_id == 302)
    assert [(p.first, p.end) for p in place] == [(50_000, 50_002)]
    kept = T.reject_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(clean) + 3
    none = T.fit(docs.limit(0), labels.limit(0))
    assert T.score(docs.limit(0), none).collect() == []
    assert all(r.score < 0.01 for r in T.score(docs, none).collect())


def test_language_on_held_out_documents(spark):
    rows = {r.doc_id: r for r in L.op5_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    right = [rows[d.doc_id].lang_pred == d.lang for d in docs if rows[d.doc_id].held_out]
    assert len(rows) == len(docs) and sum(right) >= 0.98 * len(right)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows.values())


def _plain_features(text):
    b = f" {text} ".encode().lower()
    counts = Counter()
    for size, first in ((2, 0), (3, 1 << L.BITS)):
        for i in range(len(b) - size + 1):
            counts[first + ((int.from_bytes(b[i:i + size], "little") * 2654435761 % 2**32) >> (32 - L.BITS))] += 1
    logs = {c: math.log1p(k) for c, k in counts.items()}
    norm = math.sqrt(sum(v * v for v in logs.values()))
    return {c: v / norm for c, v in logs.items()}


def test_language_decision_equals_a_plain_version(spark):
    rng = np.random.default_rng(4)

    def machine():
        return L.LinearSvm(rng.normal(size=L.DIMS), float(rng.normal()) / 5, 1.5, 0.1)

    members = {"A": ["a1", "a2", "a3"], "B": ["b1"], "C": ["c1", "c2"]}
    pairs = {(x, y): machine() for of in members.values() for i, x in enumerate(of) for y in of[i + 1:]}
    model = L.Model(members, {f: machine() for f in members}, pairs)

    def plain(text):
        if not text or not any(ch.isalpha() for ch in text):
            return "und", 0.0
        x = _plain_features(text)

        def p(svm):
            return 1 / (1 + math.exp(-(svm.slope * (sum(svm.w[c] * v for c, v in x.items()) + svm.bias) + svm.offset)))

        odds = {f: p(svm) for f, svm in model.family.items()}
        family = max(sorted(odds), key=odds.get)
        votes = dict.fromkeys(members[family], 0.0)
        for (a, b), svm in pairs.items():
            if a in votes:
                votes[a] += p(svm)
                votes[b] += 1 - p(svm)
        best = max(members[family], key=votes.get)
        others = len(members[family]) - 1
        return best, odds[family] / sum(odds.values()) * (votes[best] / others if others else 1.0)

    draw = random.Random(6)
    texts = [None, "", "12 34", "é", "x"] + ["".join(draw.choice("abcdefg éü中\n.7") for _ in range(draw.randint(1, 400))) for _ in range(150)]
    rows = L.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len({r.lang_pred for r in rows}) > 3
    for r in rows:
        lang, score = plain(texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-9)


def test_language_edge_rows(spark):
    train = [(i, t, lang, "x") for i in range(20) for t, lang in (
        (f"the house and the river {i}", "en"), (f"das haus und der fluss {i}", "de"), (f"la maison et le fleuve {i}", "fr"),
        (f"la casa y el fuego nuevo {i}", "es"), (f"dom i rzeka {i}", "pl"))]
    odd = [(None, None, None, "x"), (900, "", "en", "x"), (901, "123 !?", "en", "x"), (902, "das haus " * 20_000, None, "x")]
    docs = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, lang_pred string")
    got = L.predict(docs, L.fit(docs))
    by = [(r.doc_id, r.lang_pred, r.score) for r in got.collect()]
    assert [x for x in by if x[0] in (None, 900, 901)] == [(None, "und", 0.0), (900, "und", 0.0), (901, "und", 0.0)]
    assert [x[1] for x in by if x[0] == 902] == ["de"]
    want = [lang for _, _, lang, _ in train]
    assert [x[1] for x in by][:len(want)] == want
    none = docs.limit(0)
    assert L.predict(none, L.fit(none)).collect() == []
    assert {r.lang_pred for r in L.predict(docs, L.fit(none)).collect()} == {"und"}
    one = L.fit(docs.filter("lang = 'fr'"))
    assert {r.lang_pred for r in L.predict(docs.filter("doc_id < 20"), one).collect()} == {"fr"}
