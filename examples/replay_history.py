"""What would this rule set have sent? Replay a folder of posted alert batches.

usage: python examples/replay_history.py ALERT_DIR CONFIG.yaml OUT_DIR [MUTES_PARQUET]

Reads JSON-array bodies (one per file, arrival time = file time), routes them
through the rule set, removes alerts muted at their own time, runs the
delivery state machine (every call assumed to succeed except receivers listed
in $FAILING_RECEIVERS) and writes the outbox, the attempt log, the
notification snapshot and the observed alert state as parquet.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from alertflow import build_session  # noqa: E402
from alertflow.functions.labels import with_fingerprint  # noqa: E402
from alertflow.operators import observed  # noqa: E402
from alertflow.plans.pipeline import replay  # noqa: E402
from alertflow.sinks.outbox import outbox, write_outbox  # noqa: E402
from alertflow.sources.alerts import read_alert_batches, read_mutes  # noqa: E402
from alertflow.sources.config import RuleSet  # noqa: E402


def main(argv: list[str]) -> None:
    alert_dir, config, out = argv[:3]
    mutes_path = argv[3] if len(argv) > 3 else None
    spark = build_session()
    with open(config) as f:
        ruleset = RuleSet.from_yaml(f.read())
    alerts, rejects = read_alert_batches(spark, alert_dir)
    alerts = alerts.withColumn("call_ok", F.lit(True))
    mutes = read_mutes(spark, mutes_path) if mutes_path else None
    failing = [x for x in os.environ.get("FAILING_RECEIVERS", "").split(",") if x]
    r = replay(alerts, ruleset, mutes=mutes, failing_receivers=failing)
    write_outbox(outbox(r.plan), f"{out}/outbox")
    r.attempts.write.mode("overwrite").parquet(f"{out}/attempts")
    r.notifications.write.mode("overwrite").parquet(f"{out}/notifications")
    observed.alert_state(with_fingerprint(alerts)).write.mode("overwrite").parquet(f"{out}/alert_state")
    rejects.write.mode("overwrite").parquet(f"{out}/rejects")
    print(spark.read.parquet(f"{out}/attempts").groupBy("rule_name", "status").count()
          .orderBy("rule_name", "status").toPandas().to_string(index=False))


if __name__ == "__main__":
    main(sys.argv[1:])
