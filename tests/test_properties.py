"""Property tests: random label maps and matcher texts against the
sequential models, one Spark job per generated batch."""

from hypothesis import given, settings
from hypothesis import strategies as st

from alertflow import schemas
from alertflow.functions import labels as L
from alertflow.operators import mutes as M
from tests import models

MAP = "map<string,string>"
text = st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=6)
label_maps = st.dictionaries(text, text, max_size=5)


@settings(max_examples=5, deadline=None)
@given(st.lists(label_maps, min_size=20, max_size=60))
def test_fingerprint_property(spark, maps):
    df = spark.createDataFrame([(m,) for m in maps], f"l {MAP}")
    got = [r[0] for r in df.select(L.fingerprint("l")).collect()]
    assert got == [models.fingerprint(m) for m in maps]


token = st.text(alphabet="ab=c", min_size=1, max_size=4)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(token, min_size=1, max_size=4).map(" ".join), min_size=10, max_size=30))
def test_parse_matchers_property(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [r.p for r in df.select(L.parse_matchers_text("t").alias("p")).collect()]
    for t, p in zip(texts, out):
        want, err = {}, None
        for tok in t.split():
            i = tok.find("=")
            if i <= 0 or i == len(tok) - 1:
                err = tok
                break
            want[tok[:i]] = tok[i + 1:]
        if err is not None:
            assert p.matchers is None and p.error == f'invalid matcher "{err}": expected key=value'
        else:
            assert p.error is None and p.matchers == want


def test_no_conditions_gives_no_pairs(spark):
    import datetime as dt
    a = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), {"a": "1"})], f"alert_id long, observed_at timestamp, labels {MAP}")
    m = spark.createDataFrame([], schemas.MUTES)
    assert M.mute_pairs(a, m).count() == 0
    assert M.unmuted(a, m).count() == 1
