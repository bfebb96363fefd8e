"""Check, verify and explain a rule set, as Spark jobs.

usage: python examples/check_rules.py CONFIG.yaml [CASES.yaml] [LABELS_JSON ...]

* validation errors (first error) and lint warnings of the configuration,
* the verify table (PASS/FAIL with both mismatch messages and a summary),
* a trace of each label set given as a JSON object on the command line.

The configuration is small; results are printed from the driver.
"""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from alertflow import build_session  # noqa: E402
from alertflow.functions.labels import fingerprint  # noqa: E402
from alertflow.operators import rulesets  # noqa: E402
from alertflow.sources.config import RuleSet, cases_from_yaml  # noqa: E402


def main(argv: list[str]) -> None:
    spark = build_session()
    with open(argv[0]) as f:
        rs = RuleSet.from_yaml(f.read(), config_id=argv[0])
    rules, recv = rs.rules_df(spark), rs.receivers_df(spark)
    for r in rulesets.first_errors(rulesets.validate_rules(rules, recv)).collect():
        print("error:", r.error)
    configs = spark.createDataFrame([(argv[0],)], "config_id string")
    for w in rulesets.lint_rules(rules, configs).orderBy("ord").collect():
        print(w.warning)
    rest = argv[1:]
    if rest and rest[0].endswith((".yaml", ".yml")):
        with open(rest[0]) as f:
            cases, _ = cases_from_yaml(spark, f.read())
        res = rulesets.verify(cases, rs)
        for r in res.collect():
            print(r.report)
        s = rulesets.verify_summary(res).first()
        print(f"\n{s.passed} passed, {s.failed} failed, {s.total} total")
        rest = rest[1:]
    if rest:
        df = spark.createDataFrame([(json.loads(x),) for x in rest], "labels map<string,string>")
        df = df.withColumn("fingerprint", fingerprint("labels"))
        for r in rulesets.explain(df, rs).collect():
            if r.step is None:
                continue
            line = f"  {r.fingerprint} [{r.step}] {r.rule_name:30s} {r.verdict:5s}"
            if r.verdict == "MATCH":
                line += f"  -> {r.receiver}  ({r.action})"
            print(line + f"  {r.condition}")


if __name__ == "__main__":
    main(sys.argv[1:])
