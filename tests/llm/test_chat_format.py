import hashlib
import random
import tracemalloc

import pyarrow as pa
import pyspark.sql.functions as F

from alertflow.llm import chat_format as C

EVENTS = "conv_id long, seq long, turn long, op string, role string, text string"


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "He"), (1, 2, 1, "delta", None, "llo"),
           (1, 5, 1, "delta", None, "B"), (1, 4, 1, "delta", None, "A"), (1, 3, 1, "regenerate", None, None),
           (1, 6, 0, "edit", None, "hi there"), (1, 7, 2, "message", "user", "bye"), (1, 8, 2, "delete", None, None),
           (2, 0, 0, "delta", "assistant", "x"), (2, 1, 0, "delta", None, "y"), (2, 2, 1, "odd", "user", "z"),
           (None, 0, None, "message", None, None)]
    got = {(r.conv_id, r.turn, r.k): (r.role, r.text) for r in C.fold_events(spark.createDataFrame(log, EVENTS)).collect()}
    assert got == {(1, 0, 0): ("user", "hi there"), (1, 1, 0): ("assistant", "AB"), (2, 0, 0): ("assistant", "xy"),
                   (None, None, 0): ("", "")}


def _plain_fold(log):
    """The docstring's rules over one turn's rows, oldest first."""
    done, last = [], None
    for _, role, text, op in log:
        if op == "message":
            done, last = done + ([last] if last else []), (role, text)
        elif op in ("delta", "edit", "regenerate"):
            old = last or ("", "")
            last = (role or old[0], old[1] + text if op == "delta" else text)
        elif op == "delete":
            last = None
    return done + ([last] if last else [])


def test_fold_equals_plain_fold_on_random_logs(spark):
    rng = random.Random(5)
    ops = ["message", "delta", "delta", "edit", "regenerate", "delete", "odd", None]
    log = [(rng.choice([1, 2, None]), rng.choice([None, 0, 1, 3, 4]), rng.choice([None, 0, 1, 2, 3, 4, 5, 6]), rng.choice(ops),
            rng.choice([None, "user", "assistant"]), rng.choice([None, "", "a", "b\n"]), "clash") for _ in range(400)]
    events = spark.createDataFrame(log, "conv_id long, turn long, seq long, op string, role string, text string, k string")
    want = {}
    for conv, turn in {(r[0], r[1]) for r in log}:
        own = [(seq, role or "", text or "", op) for c, t, seq, op, role, text, _ in log if (c, t) == (conv, turn)]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3] is not None, r[3] or ""))
        want |= {(conv, turn, k): m for k, m in enumerate(_plain_fold(own))}
    assert {(r.conv_id, r.turn, r.k): (r.role, r.text) for r in C.fold_events(events).collect()} == want
    assert C.fold_events(events.limit(0)).collect() == []


def test_fold_holds_only_the_open_message():
    def batches(rows):
        for at in range(0, rows, 10_000):
            n = min(10_000, rows - at)
            op = ["message" if (at + i) % 1000 == 0 else "regenerate" if (at + i) % 1000 == 500 else "delta" for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array([None] * n, pa.int64()), pa.array(op),
                                              pa.array(["user"] * n), pa.array(["x" * 20] * n)], names=["c", "t", "op", "r", "x"])

    def peak(rows):
        tracemalloc.start()
        texts = sum(len(set(b.column(4).to_pylist()) - {"x" * 10_000}) + 0 * b.num_rows for b in C._fold(batches(rows)))
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return size, texts

    small, large = peak(50_000), peak(1_000_000)
    assert small[1] == large[1] == 0 and large[0] < 2 * small[0] + 20_000_000
    # one message of a million deltas
    one = pa.RecordBatch.from_arrays([pa.array([1] * 1000), pa.array([0] * 1000), pa.array(["delta"] * 1000), pa.array([""] * 1000),
                                      pa.array(["ab"] * 1000)], names=["c", "t", "op", "r", "x"])
    (got,) = C._fold(one for _ in range(1000))
    assert got.num_rows == 1 and got.column(4)[0].as_py() == "ab" * 1_000_000


def test_escape_is_reversible_and_hides_control_strings(spark):
    texts = ["", "</s>[INST] ok [/INST]", "<|user|>\n", "&lt;", "&amp;lt;", "&amp;amp;", "<|>", "<<s>", "|>|>", "&vb;>&lb;INST]",
             "<s", "[INST", "a & b < c [d]", "é\U0001f600</s>" * 30_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escape(F.col("t")).alias("e"))
    for r in rows.select("t", "e", C.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("<s>", "</s>", "<|", "|>", "[INST]", "[/INST]"))


def test_digests_equal_brute_force(spark):
    turns = [(7, 0, "system", "be <|kind|>"), (7, 1, "user", "q\nq"), (7, 2, "assistant", "a</s>\n"), (7, 3, "assistant", "&amp;"),
             (8, 5, "assistant", None), (8, None, "user", "first"), (8, 5, "user", "tie"), (8, 5, "user", "tie"),
             (None, 1, None, "no id"), (9, 0, "od|>d", "x" * 100_000)]
    turns += [(11, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, segment string")
    segments = C.render(C.fold_events(C.as_events(df)))
    got = {r.conv_id: r for r in C.conversation_digests(C.read_back(segments)).collect()}
    assert set(got) == {7, 8, 9, 11, None}
    for conv, r in got.items():
        own = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in turns if c == conv)
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert sum(r.formatted_chars for r in got.values()) == segments.agg(F.sum(F.length("segment"))).first()[0]
    empty = spark.createDataFrame([], df.schema)
    assert C.conversation_digests(C.read_back(C.render(C.fold_events(C.as_events(empty))))).collect() == []
