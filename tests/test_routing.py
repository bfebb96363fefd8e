import random

from alertflow.operators import routing
from alertflow.sources.config import EXAMPLE_CASES, Receiver, Rule, RuleSet, example_ruleset
from tests import models

MAP = "map<string,string>"


def _alerts(spark, label_sets):
    return spark.createDataFrame([(i, l) for i, l in enumerate(label_sets)], f"alert_id long, labels {MAP}")


def _decided(df):
    got = {}
    for r in df.select("alert_id", "rule_idx").collect():
        got.setdefault(r.alert_id, []).append(r.rule_idx)
    return {k: sorted(v) for k, v in got.items()}


def test_golden_cases(spark):
    rs = example_ruleset()
    df = _alerts(spark, [c[1] for c in EXAMPLE_CASES])
    d = routing.route(df, rs).select("alert_id", "rule_idx", "rule_name", "receiver").collect()
    got = {}
    for r in d:
        got.setdefault(r.alert_id, []).append((r.rule_idx, r.rule_name, r.receiver))
    for i, case in enumerate(EXAMPLE_CASES):
        names = [n for _, n, _ in sorted(got[i])]
        recv = [x for _, _, x in sorted(got[i])]
        assert sorted(names) == sorted(case[2]) and sorted(recv) == sorted(case[3]), case[0]


def _random_rules(rng, n):
    keys, vals = ["a", "b", "c"], ["", "1", "2"]
    rules = []
    for i in range(n):
        match = {k: rng.choice(vals) for k in rng.sample(keys, rng.randint(0, 2))}
        rules.append(Rule(f"r{i}", match, f"recv{i % 3}", rng.random() < 0.4))
    return RuleSet(rules, [Receiver(f"recv{i}") for i in range(3)])


def _random_labels(rng, n):
    keys, vals = ["a", "b", "c"], ["", "1", "2"]
    return [{k: rng.choice(vals) for k in rng.sample(keys, rng.randint(0, 3))} for _ in range(n)]


def test_random_against_model_both_forms(spark):
    rng = random.Random(11)
    for trial in range(3):
        rs = _random_rules(rng, 9)
        labels = _random_labels(rng, 300)
        df = _alerts(spark, labels)
        want = {i: models.evaluate([(r.name, r.match, r.receiver, r.cont) for r in rs.rules], l)
                for i, l in enumerate(labels)}
        want = {k: v for k, v in want.items() if v}
        assert _decided(routing.route(df, rs)) == want
        assert _decided(routing.route_join(df, rs)) == want


def test_unrouted_and_empty_rules(spark):
    rs = RuleSet([Rule("only", {"a": "1"}, "x")], [Receiver("x")])
    df = _alerts(spark, [{"a": "1"}, {"a": "2"}, {}])
    assert sorted(r.alert_id for r in routing.unrouted(df, rs).collect()) == [1, 2]
    assert routing.route(df, RuleSet([], [])).count() == 0


def test_unknown_receiver_skips_only_that_decision(spark):
    rs = RuleSet([Rule("a", {}, "ghost", True), Rule("b", {}, "real")], [Receiver("real", "webhook", "u")])
    df = _alerts(spark, [{"x": "1"}])
    d = routing.route(df, rs)
    kept = routing.known_receiver_decisions(d, rs).select("rule_name", "receiver_type").collect()
    assert [(r.rule_name, r.receiver_type) for r in kept] == [("b", "webhook")]
    warn = routing.unknown_receiver_warnings(d, rs).collect()
    assert [(w.rule_name, w.receiver) for w in warn] == [("a", "ghost")]


def test_route_plan_has_no_shuffle(spark):
    df = _alerts(spark, [{"a": "1"}])
    plan = routing.route(df, example_ruleset())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_report_counts(spark):
    df = _alerts(spark, [c[1] for c in EXAMPLE_CASES])
    rep = {(r.rule_name, r.receiver): r.decisions
           for r in routing.routing_report(routing.route(df, example_ruleset())).collect()}
    assert rep[("critical-mirror", "oncall-mirror")] == 2 and rep[("catch-all", "log-sink")] == 1
    assert sum(rep.values()) == 7


def test_large_rule_set_uses_join_form(spark):
    rng = random.Random(17)
    rs = _random_rules(rng, routing.COMPILED_MAX_RULES + 44)
    labels = _random_labels(rng, 200)
    df = _alerts(spark, labels)
    want = {i: models.evaluate([(r.name, r.match, r.receiver, r.cont) for r in rs.rules], l)
            for i, l in enumerate(labels)}
    want = {k: v for k, v in want.items() if v}
    out = routing.route(df, rs)
    assert _decided(out) == want


def test_compiled_and_join_form_agree_with_nulls(spark):
    import random

    from alertflow.operators import rulesets
    from alertflow.sources.config import Receiver, Rule, RuleSet

    rng = random.Random(8)
    value = lambda: rng.choice(["a", "b", "", None])
    labels = [None, {}] + [{k: value() for k in rng.sample("xyz", rng.randint(0, 3))} for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(labels)), "id long, labels map<string,string>")
    for n in (0, 1, 7, 40):
        rules = [Rule(f"r{i}", {k: value() for k in rng.sample("xyz", rng.randint(1, 2))}, f"v{i % 3}", rng.random() < 0.6)
                 for i in range(n)]
        rs = RuleSet(rules, [Receiver("v0"), Receiver("v1")])
        want = {}
        for i, labs in enumerate(labels):
            got = []
            for k, r in enumerate(rules):
                if all(((labs or {}).get(key) or "") == (v or "") for key, v in r.match.items()):
                    got.append(k)
                    if not r.cont:
                        break
            want[i] = got
        for most in (-1, 1000):
            hits = {r.id: r._hits for r in routing.with_hits(df, rs, compiled_max=most).collect()}
            assert hits == want
            assert {r.id for r in routing.unrouted(df, rs, compiled_max=most).collect()} == {i for i, h in want.items() if not h}
        final = {r.id: r for r in rulesets.final_decisions(df, rs, key="id").collect()}
        assert all((final[i].outcome == "dropped") == (not h) for i, h in want.items())
        if not n:
            assert {r.final for r in final.values()} == {"none, alert would be dropped"}
            assert rulesets.explain(df, rs, key="id").select("id").distinct().count() == len(labels)


def test_two_thousand_rules(spark):
    from alertflow.operators import rulesets
    from alertflow.sources.config import Receiver, Rule, RuleSet

    rs = RuleSet([Rule(f"r{i}", {"user": str(i)}, "v", i % 2 == 0) for i in range(1999)] + [Rule("all", {}, "v")],
                 [Receiver("v")])
    df = spark.createDataFrame([(i, {"user": str(i)}) for i in (0, 1, 1998, 5000)], "id long, labels map<string,string>")
    got = sorted((r.id, r.rule_name) for r in routing.route(df, rs).collect())
    assert got == [(0, "all"), (0, "r0"), (1, "r1"), (1998, "all"), (1998, "r1998"), (5000, "all")]
    assert routing.unrouted(df, rs).count() == 0
    steps = rulesets.explain(df, rs, key="id").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in steps} == {0: 2000, 1: 2, 1998: 2000, 5000: 2000}
