"""Ranked search against a brute-force ranking."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from alertflow.llm import ranked_search
from alertflow.llm.ranked_search import TERM, Shard, search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, queries, k=10):
    words = [(d, re.findall(TERM, (t or "").translate(LOWER))) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in queries:
        asked = set(re.findall(TERM, (text or "").translate(LOWER)))
        scored = []
        for d, w in words:
            m, tf = 10 + 90 * len(w) * n_docs // n_terms, Counter(w)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in asked if tf[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, queries, k=10, extra=False):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "item_id long, text string")
    if extra:
        d = d.selectExpr("*", "1 AS n", "'x' AS terms", "2 AS score", "3 AS item_id", "4 AS query")
        q = q.selectExpr("*", "'y' AS doc_id", "5 AS rank")
    out = search(d.repartition(3), q, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Über", "naïve", "ABC9", "x"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    docs = [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(40)]           # copies: equal scores, smaller ids first
    docs += [(7, docs[5][1]), (None, docs[3][1]), (None, None), (n + 50, ""), (n + 51, " .,;\n\u0001")]
    return docs, vocab


@pytest.mark.parametrize("shard", [50, 4_000_000])
def test_equals_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", shard)
    docs, vocab = corpus(150)
    rng = random.Random(2)
    queries = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 20)))) for i in range(12)]
    queries += [(90, "nowhere to be found"), (91, None), (92, "..."), (93, "W1 w1 w1-W1"), (93, "W1 w1 w1-W1"), (None, "über w3")]
    assert found(spark, docs, queries, extra=True) == brute(docs, queries)


def test_query_blocks_and_fewer_documents_than_k(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERY_BLOCK_BYTES", 200)
    docs, vocab = corpus(4)
    queries = [(i, " ".join(vocab[i:i + 5])) for i in range(10)]
    assert found(spark, docs, queries, k=3) == brute(docs, queries, 3)


def test_very_long_text_and_empty_tables(spark):
    docs = [(1, "common " * 300_000 + "rare"), (2, "rare"), (3, "common")]
    assert found(spark, docs, [(1, "rare common")]) == brute(docs, [(1, "rare common")])
    assert found(spark, [], [(1, "a")]) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_a_term_of_every_document_weighs_nothing(spark):
    docs = [(i, "all") for i in range(2000)]
    assert found(spark, docs, [(1, "all")]) == brute(docs, [(1, "all")])


def test_reads_stop_before_the_end_of_the_lists(monkeypatch):
    """One rare term decides: the walk settles the answer without reading the frequent term's list block by block."""
    n = 20_000
    doc = np.concatenate([np.arange(n), [5, 6, 7]])
    term = np.concatenate([np.zeros(n, int), np.ones(3, int)])
    times = np.concatenate([np.ones(n, int), [9, 8, 7]])
    shard = Shard(np.arange(n), np.full(n, 10), doc, term, times, np.array([1, 9000]), n, 10 * n)
    rounds = []
    best = ranked_search._best
    monkeypatch.setattr(ranked_search, "_best", lambda lower, k: rounds.append(1) or best(lower, k))
    assert [d for _, d in shard.top(np.array([0, 1]), 3)] == [5, 6, 7]
    assert len(rounds) <= 2
    assert len(shard.top(np.array([0]), 3)) == 3
