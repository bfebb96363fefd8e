import random
from collections import Counter

import numpy as np
import pytest

from alertflow.llm import minhash_forest as M
from alertflow.llm.components import connected_components, extended_components


def word_shingles(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    n = min(5, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_components(rows):
    """Smallest id reachable over links of similarity 0.75 or more, per row (ids that are null: null)."""
    sets = [word_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(s), least[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 1), (5, 9), (9, 12), (20, 21), (12, 30)],
                                   [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if len(edges) > 150:
            root = {x: min(root.values()) for x in root}
    assert got == root


def test_links_equal_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    rows, doc_id = [], 0
    for _ in range(25):  # families of near copies, some of them chains that drift
        words = [rng.choice(vocab) for _ in range(rng.choice([8, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((doc_id, rng.choice([" ", "  ", "\n"]).join(words)))
            doc_id += 1
    base = [rng.choice(vocab) for _ in range(300)]  # a dense region: many copies with one edit each
    for i in range(150):
        words = list(base)
        words[rng.randrange(300)] = f"edit{i}"
        rows.append((doc_id, " ".join(words)))
        doc_id += 1
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "Two Words"), (9004, "two words"), (9005, "two  WORDS"),
             (9006, "É words"), (9007, "é words"), (None, "two words"), (9003, "other text under the same id here"),
             (9008, "z " * 100_000), (9009, "z " * 30)]
    rows += [(9100, "five words are one shingle"), (9101, "five words are one shingle")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in M.near_duplicates(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(rows)))
    kept = M.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = sorted(repr(d) for d, _, c in brute_components(rows) if d is None or c == d)
    assert sorted(repr(r.doc_id) for r in kept.collect()) == want
    empty = spark.createDataFrame([], df.schema)
    assert M.near_duplicates(empty).collect() == [] and M.drop_near_duplicates(empty).collect() == []


def test_no_link_is_lost_among_near_misses(spark):
    """Texts of one template at similarity 0.68 or so; planted pairs at 0.75 to 0.80 that nothing else joins."""
    rng = random.Random(5)
    template = [f"t{i}" for i in range(1000)]

    def edited(edits):
        words = list(template)
        for at, word in edits.items():
            words[at] = word
        return " ".join(words)

    def edits(n):
        return {at: f"e{rng.random()}" for at in rng.sample(range(1000), n)}

    texts = [edited(edits(19)) for _ in range(1200)]
    for _ in range(200):
        one = edits(19)
        shared = rng.choice([5, 6, 7])
        texts += [edited(one), edited(dict(list(one.items())[:shared]) | edits(19 - shared))]
    rng.shuffle(texts)

    sets = [word_shingles(t) for t in texts]
    seen = Counter(s for x in sets for s in x)
    place = {s: i for i, s in enumerate(s for s, n in seen.items() if n > 1)}
    held = np.zeros((len(texts), len(place)), np.float32)
    for i, x in enumerate(sets):
        held[i, [place[s] for s in x if s in place]] = 1
    both, size = held @ held.T, np.array([len(x) for x in sets])
    root = np.arange(len(texts))
    for i, j in np.argwhere(np.triu(100 * both >= 75 * (size[:, None] + size - both), 1)):
        root[root == max(root[i], root[j])] = min(root[i], root[j])
    assert len(set(root.tolist())) > 1000  # most texts are near misses only

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in M.near_duplicates(df).collect()} == dict(enumerate(root.tolist()))


def test_components_go_on_from_known_ones(spark):
    rng = random.Random(12)
    edges = [tuple(rng.sample(range(400), 2)) for _ in range(330)]
    spread = spark.createDataFrame(edges, "a long, b long")
    for cut in (0, 100, 320, 330):  # nothing known, nothing new
        known = connected_components(spark.createDataFrame(edges[:cut], spread.schema))
        got = extended_components(known, spark.createDataFrame(edges[cut:], spread.schema)).collect()
        least = {n: n for e in edges for n in e}
        for _ in least:
            before = dict(least)
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
            if least == before:
                break
        assert sorted(map(tuple, got)) == sorted(least.items())
