import pytest

from alertflow import schemas
from alertflow.operators import rulesets as RS
from alertflow.sources.config import EXAMPLE_CASES, Receiver, Rule, RuleSet, example_cases, example_ruleset

MAP = "map<string,string>"


def _cfg(spark, rules, receivers, cid="c"):
    rs = RuleSet(rules, receivers, cid)
    return rs.rules_df(spark), rs.receivers_df(spark)


def _first(spark, rules, receivers):
    r, v = _cfg(spark, rules, receivers)
    out = RS.first_errors(RS.validate_rules(r, v)).collect()
    return out[0].error if out else None


def test_validation_first_error(spark):
    ok = [Receiver("x", "webhook", "http://u")]
    assert _first(spark, [Rule("a", {}, "x")], ok) is None
    assert _first(spark, [Rule("a", {}, "x")], [Receiver("x", "pagerduty", "u")]) == \
        'receiver "x": unknown receiver type "pagerduty" (only "webhook" is configurable)'
    assert _first(spark, [Rule("a", {}, "x")], [Receiver("x", "webhook", "")]) == \
        'receiver "x": webhook receiver requires url or url_file'
    assert _first(spark, [Rule("a", {}, "nope")], ok) == 'rule "a": references undefined receiver "nope"'
    assert _first(spark, [Rule("a", {}, "x"), Rule("a", {}, "x")], ok) == 'rule #2: duplicate name "a"'
    assert _first(spark, [Rule("", {}, "x")], ok) == "rule #1: name is required"
    assert _first(spark, [Rule("a", {}, "")], ok) == 'rule "a": receiver is required'
    assert _first(spark, [Rule("a", {}, "x")], [Receiver("x", "", "u")]) == 'receiver "x": type is required'
    # receivers are checked before rules
    assert _first(spark, [Rule("", {}, "x")], [Receiver("x", "bad", "u")]).startswith('receiver "x"')
    assert _first(spark, [Rule("a", {}, "x")], ok + [Receiver("x", "webhook", "v")]) == 'receiver "x": duplicate name'


def test_lint(spark):
    rules = [Rule("ca", {}, "x", False), Rule("mid", {"a": "1"}, "x"), Rule("last", {"b": "1"}, "x")]
    r, _ = _cfg(spark, rules, [Receiver("x", "webhook", "u")])
    configs = spark.createDataFrame([("c",), ("empty",)], "config_id string")
    w = sorted((x.config_id, x.warning) for x in RS.lint_rules(r, configs).collect())
    assert len(w) == 3
    assert w[0][1].startswith("warning: last rule is not a catch-all")
    assert w[1][1].startswith('warning: rule #1 ("ca") is a non-continue catch-all')
    assert w[2] == ("empty", "warning: no rules defined; all alerts will be dropped")
    r2, _ = _cfg(spark, example_ruleset().rules, [])
    assert RS.lint_rules(r2).count() == 0
    # {x: ''} is not a catch-all for lint
    r3, _ = _cfg(spark, [Rule("a", {"x": ""}, "r")], [])
    assert RS.lint_rules(r3).count() == 1


def test_verify_golden_and_missing_list(spark):
    res = RS.verify(example_cases(spark), example_ruleset()).collect()
    assert all(r["pass"] for r in res) and len(res) == len(EXAMPLE_CASES)
    extra = spark.createDataFrame([("no lists", {"severity": "critical", "team": "infra"}, None, None, None)],
                                  schemas.CASES)
    r = RS.verify(extra, example_ruleset()).first()
    assert not r["pass"]
    assert r.mismatches == ["expected rules     [], got [critical-mirror critical-to-infra]",
                            "expected receivers [], got [infra-critical-pager oncall-mirror]"]
    s = RS.verify_summary(RS.verify(example_cases(spark).unionByName(extra), example_ruleset())).first()
    assert (s.passed, s.failed, s.total) == (6, 1, 7)


def test_explain_trace(spark):
    df = spark.createDataFrame([("fp", {"severity": "critical", "team": "infra"}, False),
                                ("fm", {"x": "1"}, True)], f"fingerprint string, labels {MAP}, muted boolean")
    rows = RS.explain(df, example_ruleset(), muted_col="muted").collect()
    tr = [(r.step, r.rule_name, r.verdict, r.action) for r in rows if r.fingerprint == "fp"]
    assert tr == [(1, "critical-to-infra", "MATCH", "continue"), (2, "critical-mirror", "MATCH", "stop")]
    fm = [r for r in rows if r.fingerprint == "fm"]
    assert len(fm) == 1 and fm[0].mute_check == "MATCHED" and fm[0].step is None
    top = [r for r in rows if r.fingerprint == "fp"][0]
    assert top.label_text == 'severity="critical", team="infra"' and top.receiver_type == "webhook"
    assert top.condition == 'severity="critical", team="infra"'


def test_config_from_dict():
    cfg = {"receivers": [{"name": "r", "type": "webhook", "url": "u"}],
           "rules": [{"name": "a", "receiver": "r"}, {"name": "b", "match": {"x": "1"}, "receiver": "r",
                                                       "continue": True}]}
    rs = RuleSet.from_dict(cfg)
    assert rs.rules[0].match == {} and rs.rules[1].cont and rs.receivers[0].url == "u"


def test_receiver_name_required_message(spark):
    assert _first(spark, [Rule("a", {}, "x")], [Receiver("x", "webhook", "u"), Receiver("", "webhook", "u")]) == \
        "receiver #2: name is required"


def test_config_from_yaml_and_tables(spark):
    text = """
receivers:
  - name: r
    type: webhook
    url: http://u
rules:
  - name: a
    match: {x: "1"}
    receiver: r
    continue: true
  - name: b
    match: {}
    receiver: r
"""
    rs = RuleSet.from_yaml(text)
    assert [r.name for r in rs.rules] == ["a", "b"] and rs.rules[0].cont and rs.rules[1].match == {}
    back = RuleSet.from_dataframes(rs.rules_df(spark), rs.receivers_df(spark))
    assert back.rules == rs.rules and back.receivers == rs.receivers


def test_config_json_files_and_yaml_cases(spark):
    import json
    import os
    import tempfile
    from alertflow.operators import rulesets as R
    from alertflow.sources.config import cases_from_yaml, read_config_json
    d = tempfile.mkdtemp(prefix="af-cfg-")
    good = {"receivers": [{"name": "r", "type": "webhook", "url": "u"}],
            "rules": [{"name": "a", "match": {"x": "1"}, "receiver": "r", "continue": True},
                      {"name": "b", "receiver": "r"}]}
    bad = {"receivers": [{"name": "r", "type": "webhook", "url": "u"}],
           "rules": [{"name": "a", "receiver": "nope"}, {"name": "z", "match": {"y": "2"}, "receiver": "r"}]}
    for n, doc in (("good.json", good), ("bad.json", bad)):
        with open(os.path.join(d, n), "w") as f:
            json.dump(doc, f, indent=1)
    rules, recv = read_config_json(spark, d)
    got = sorted((os.path.basename(r.config_id), r.rule_idx, r.name, r["continue"]) for r in rules.collect())
    assert got == [("bad.json", 0, "a", False), ("bad.json", 1, "z", False),
                   ("good.json", 0, "a", True), ("good.json", 1, "b", False)]
    errs = {os.path.basename(r.config_id): r.error for r in R.first_errors(R.validate_rules(rules, recv)).collect()}
    assert errs == {"bad.json": 'rule "a": references undefined receiver "nope"'}
    lint = {os.path.basename(r.config_id) for r in R.lint_rules(rules).collect()}
    assert lint == {"bad.json"}
    cases, rejects = cases_from_yaml(spark, """
verify:
  - name: critical
    labels: {severity: critical, team: infra}
    expect:
      rules: [critical-to-infra, critical-mirror]
      receivers: [infra-critical-pager, oncall-mirror]
  - name: ""
    labels: {a: b}
""")
    assert cases.count() == 1 and rejects.count() == 1
    assert R.verify(cases, example_ruleset()).first()["pass"]


def test_verify_report_text(spark):
    cases = spark.createDataFrame(
        [("ok", {"severity": "critical", "team": "platform"}, ["critical-mirror"], ["oncall-mirror"], None),
         ("bad", {"x": "1"}, ["critical-mirror"], ["log-sink"], "why it matters\n")], schemas.CASES)
    rep = {r.name: r.report for r in RS.verify(cases, example_ruleset()).collect()}
    assert rep["ok"] == "PASS  ok"
    assert rep["bad"] == ("FAIL  bad\n      why it matters\n"
                          "      expected rules     [critical-mirror], got [catch-all]")


def test_tables_of_several_rule_sets_need_a_name_and_respect_the_bound(spark):
    from alertflow import schemas
    from alertflow.sources.config import RuleSet

    rules = spark.createDataFrame([(0, "r", {}, "v", False, "a"), (0, "q", {}, "v", False, "b")], schemas.RULES)
    recv = spark.createDataFrame([(i, f"v{i}", "webhook", "u", c, None) for c in "ab" for i in range(3)], schemas.RECEIVERS)
    with pytest.raises(ValueError):
        RuleSet.from_dataframes(rules, recv)
    with pytest.raises(ValueError):
        RuleSet.from_dataframes(rules, recv, max_rules=2, config_id="a")
    assert [r.name for r in RuleSet.from_dataframes(rules, recv, config_id="b").rules] == ["q"]


def test_yaml_scalars_stay_text_and_url_file_counts(spark):
    from alertflow.operators import rulesets
    from alertflow.sources.config import RuleSet

    pytest.importorskip("yaml")
    rs = RuleSet.from_yaml("receivers:\n- {name: v, type: webhook, url_file: /run/secret}\n"
                           "rules:\n- {name: on, match: {port: 80, up: true, v: 1e3}, receiver: v, continue: true}\n")
    assert rs.rules[0].match == {"port": "80", "up": "true", "v": "1e3"} and rs.rules[0].name == "on" and rs.rules[0].cont
    assert rulesets.validate_rules(rs.rules_df(spark), rs.receivers_df(spark)).count() == 0
