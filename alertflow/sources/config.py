"""Rule sets, receivers and verify cases.

A rule set is configuration: a short ordered list known on the driver, like a
YAML file. It is turned into DataFrames with an explicit ``rule_idx`` (the
position is its meaning) or compiled into one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertflow import schemas


@dataclass(frozen=True)
class Rule:
    name: str
    match: dict = field(default_factory=dict)
    receiver: str = ""
    cont: bool = False


@dataclass(frozen=True)
class Receiver:
    name: str
    type: str = "webhook"
    url: str = ""
    url_file: str = ""  # kept as text; the file (a secret) is not read here


@dataclass
class RuleSet:
    rules: list
    receivers: list
    config_id: str = "default"

    def receiver_map(self) -> dict:
        return {r.name: r for r in self.receivers}

    def rules_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, r.name, dict(r.match or {}), r.receiver, bool(r.cont), self.config_id)
                for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, schemas.RULES)

    def receivers_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, r.name, r.type, r.url, self.config_id, r.url_file) for i, r in enumerate(self.receivers)]
        return spark.createDataFrame(rows, schemas.RECEIVERS)

    @staticmethod
    def from_dict(cfg: dict, config_id: str = "default") -> "RuleSet":
        """Build from the parsed YAML layout (``receivers:`` and ``rules:``)."""
        text = lambda r, k: scalar_text(r.get(k))
        recv = [Receiver(text(r, "name"), text(r, "type"), text(r, "url"), text(r, "url_file"))
                for r in cfg.get("receivers", []) or []]
        rules = [Rule(text(r, "name"), {scalar_text(k): scalar_text(v) for k, v in (r.get("match") or {}).items()},
                      text(r, "receiver"), r.get("continue", False) in (True, "true", "True", "TRUE"))
                 for r in cfg.get("rules", []) or []]
        return RuleSet(rules, recv, config_id)

    @staticmethod
    def from_yaml(text: str, config_id: str = "default") -> "RuleSet":
        """S6 convenience on the driver: the YAML configuration layout.
        Secrets in ``url_file`` are not read here; pass resolved URLs."""
        try:
            import yaml
        except ImportError as e:  # pragma: no cover - optional dependency
            raise RuntimeError("PyYAML is needed for from_yaml; use from_dict") from e
        return RuleSet.from_dict(yaml.load(text, Loader=_text_loader(yaml)) or {}, config_id)

    @staticmethod
    def from_dataframes(rules: DataFrame, receivers: DataFrame, max_rules: int = 100_000,
                        config_id: str | None = None) -> "RuleSet":
        """Rule sets kept as tables: read back to the driver with a bound (a
        rule set is configuration, not data). Tables with several
        ``config_id`` need one to be named; more than ``max_rules`` rules or
        receivers are refused, never cut."""
        if config_id is not None:
            rules, receivers = rules.where(F.col("config_id") == config_id), receivers.where(F.col("config_id") == config_id)
        rr = rules.orderBy("rule_idx").limit(max_rules + 1).collect()
        if len(rr) > max_rules:
            raise ValueError(f"rule set larger than {max_rules} rules")
        vv = receivers.limit(max_rules + 1).collect()
        if len(vv) > max_rules:
            raise ValueError(f"rule set larger than {max_rules} receivers")
        ids = {r["config_id"] for r in [*rr, *vv] if "config_id" in r}
        if len(ids) > 1:
            raise ValueError(f"several rule sets: name one config_id of {sorted(map(str, ids))[:5]}")
        return RuleSet([Rule(r["name"], dict(r["match"] or {}), r["receiver"], bool(r["continue"])) for r in rr],
                       [Receiver(v["name"], v["type"], v["url"] or "", v["url_file"] or "" if "url_file" in v else "")
                        for v in vv],
                       next(iter(ids), None) or "default")


def scalar_text(v) -> str:
    """A configuration scalar as the text it was written as (NULL: '')."""
    if v is None:
        return ""
    return ("true" if v else "false") if isinstance(v, bool) else str(v)


def _text_loader(yaml):
    """YAML loader that keeps every scalar as text (``port: 80``, ``on``, ``1e3`` stay as written); only null is resolved."""
    class Loader(yaml.SafeLoader):
        pass
    Loader.yaml_implicit_resolvers = {
        first: [(tag, exp) for tag, exp in pairs if tag in ("tag:yaml.org,2002:null", "tag:yaml.org,2002:merge")]
        for first, pairs in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    return Loader


# The example configuration shipped with the reference
# (receivers, then rules in file order).
EXAMPLE_RECEIVERS = [
    Receiver("infra-critical-pager", "webhook", "http://127.0.0.1:8000"),
    Receiver("oncall-mirror", "webhook", "http://127.0.0.1:8000"),
    Receiver("infra-warning-chat", "webhook", "http://127.0.0.1:8000"),
    Receiver("failing-webhook", "webhook", "http://127.0.0.1:9999"),
    Receiver("log-sink", "webhook", "http://127.0.0.1:8000"),
]
EXAMPLE_RULES = [
    Rule("critical-to-infra", {"severity": "critical", "team": "infra"}, "infra-critical-pager", True),
    Rule("critical-mirror", {"severity": "critical"}, "oncall-mirror", False),
    Rule("infra-warnings", {"team": "infra", "severity": "warning"}, "infra-warning-chat", False),
    Rule("chaos-fail", {"chaos": "fail"}, "failing-webhook", False),
    Rule("noisy-suppress", {"source": "noisy-system"}, "log-sink", False),
    Rule("catch-all", {}, "log-sink", False),
]
# The receiver whose endpoint is a closed port in the example: every call fails.
EXAMPLE_FAILING_RECEIVERS = ("failing-webhook",)

# The example verify table (name, labels, rules, receivers).
EXAMPLE_CASES = [
    ("critical infra alert fans out to pager and mirror", {"severity": "critical", "team": "infra"},
     ["critical-to-infra", "critical-mirror"], ["infra-critical-pager", "oncall-mirror"],
     "critical-to-infra has continue:true, so critical-mirror also fires.\n"),
    ("critical platform alert reaches mirror only", {"severity": "critical", "team": "platform"},
     ["critical-mirror"], ["oncall-mirror"], None),
    ("infra warning reaches chat", {"severity": "warning", "team": "infra"},
     ["infra-warnings"], ["infra-warning-chat"], None),
    ("chaos label routes to failing-webhook", {"chaos": "fail", "alertname": "ChaosTest"},
     ["chaos-fail"], ["failing-webhook"], None),
    ("noisy source routed to log sink", {"source": "noisy-system", "severity": "warning"},
     ["noisy-suppress"], ["log-sink"], None),
    ("unmatched alert falls through to catch-all log sink", {"alertname": "SomethingUnknown"},
     ["catch-all"], ["log-sink"], None),
]


def example_ruleset() -> RuleSet:
    return RuleSet(list(EXAMPLE_RULES), list(EXAMPLE_RECEIVERS), "example")


def example_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXAMPLE_CASES, schemas.CASES)


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Verify cases from JSON lines; rows without a name are rejected."""
    df = spark.read.schema(schemas.CASES).json(path)
    ok = F.coalesce(F.col("name"), F.lit("")) != ""
    rejects = (df.filter(~ok).withColumn("error", F.lit("name is required")))
    return df.filter(ok), rejects


_CONFIG_JSON = T.StructType([
    T.StructField("receivers", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("type", T.StringType()),
        T.StructField("url", T.StringType()), T.StructField("url_file", T.StringType())]))),
    T.StructField("rules", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("match", schemas.LABELS),
        T.StructField("receiver", T.StringType()), T.StructField("continue", T.BooleanType())]))),
])


def read_config_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Configuration files in JSON (one document per file, the YAML
    layout), as ``rules`` and ``receivers`` DataFrames. ``posexplode`` gives
    each rule its position, which is its meaning; ``config_id`` is the file.
    Many candidate rule sets load in one read and are checked by R17/R18."""
    doc = (spark.read.schema(_CONFIG_JSON).option("multiLine", "true").json(path)
           .withColumn("config_id", F.col("_metadata.file_path")))
    rules = doc.select("config_id", F.posexplode_outer("rules").alias("rule_idx", "r")).where(F.col("r").isNotNull())
    rules = rules.select(F.col("rule_idx").cast("int").alias("rule_idx"), F.col("r.name").alias("name"),
                         F.coalesce(F.col("r.match"), F.create_map().cast(schemas.LABELS)).alias("match"),
                         F.col("r.receiver").alias("receiver"),
                         F.coalesce(F.col("r.continue"), F.lit(False)).alias("continue"), "config_id")
    recv = doc.select("config_id", F.posexplode_outer("receivers").alias("receiver_idx", "v")).where(
        F.col("v").isNotNull())
    recv = recv.select(F.col("receiver_idx").cast("int").alias("receiver_idx"), F.col("v.name").alias("name"),
                       F.col("v.type").alias("type"), F.col("v.url").alias("url"), "config_id",
                       F.col("v.url_file").alias("url_file"))
    return rules, recv


def cases_from_yaml(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """S7 for the YAML case table (``verify:`` list): parsed on the driver
    (a configuration file), returned as ``(cases, rejects)``; an omitted
    expectation is an empty list."""
    try:
        import yaml
    except ImportError as e:  # pragma: no cover - optional dependency
        raise RuntimeError("PyYAML is needed for cases_from_yaml") from e
    doc = yaml.load(text, Loader=_text_loader(yaml)) or {}
    rows = []
    for c in doc.get("verify", []) or []:
        exp = c.get("expect") or {}
        rows.append((c.get("name") or "", {scalar_text(k): scalar_text(v) for k, v in (c.get("labels") or {}).items()},
                     list(exp.get("rules") or []), list(exp.get("receivers") or []), c.get("description")))
    df = spark.createDataFrame(rows, schemas.CASES)
    ok = F.col("name") != ""
    return df.where(ok), df.where(~ok).withColumn("error", F.lit("name is required"))
