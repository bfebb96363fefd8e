"""Alert readers (S1, S2, S3, S9) and the stored-table readers.

A posted batch is a JSON array of v2-format alerts. The whole file is
read as one text value, decoded element by element and exploded with its
position, so arrival order survives as ``seq``. A body that does not parse is
rejected whole, as the reference rejects the request.

The decode follows the service's typed one: field names match without regard
to case, of repeated names the last value counts (repeated ``labels`` objects
are merged, a null empties what was there), a body ``null`` has no alerts,
and label values, times and the URL must be texts or null.

``seq`` orders the alerts of bodies with one arrival time. Every reader computes
it from the body's own name and the position in it, so a history read as a
batch, the same files read as a stream, and a retried micro-batch give the same
numbers; no reader ranks, joins or gathers bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertflow import schemas
from alertflow.functions.labels import no_null_values
from alertflow.functions.status import zero_time_to_null

# Elements of one body and ordinals of bodies share the 63 bits of ``seq``: 20 bits for the position, 42 for the
# ordinal. A file's ordinal is the last number in its name and a digest of its path, a message's its offset and partition.
_MAX_ELEMENTS = 1 << 20
_NUMBER_DIGITS, _DIGEST_BITS = 6, 22
_PARTITION_BITS, _ORDINAL_BITS = 10, 42
#: The number that orders files of one modification time: the last digits of the file's name.
FILE_NUMBER = r"(\d+)\D*$"
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
# The time forms that a posted time may have; without a zone it is UTC, the empty text is 1970.
_TIME_FORMS = "|".join([
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3}|\.\d{6})[+-]\d{4}",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}Z?",
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?",
    r"\d{4}-\d{2}-\d{2}",
    "",
])
_TIME_PARTS = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?$"
# A text that is a value, found from the end of the one before: all up to its opening quote, names included; then the rest.
_TEXT_VALUE = r'(?s)\G((?:[^"]++|"(?:[^"\\]|\\.)*+"\s*+:)*+")((?:[^"\\]|\\.)*+")'
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _normalise(df: DataFrame) -> DataFrame:
    """S9 + F10: missing labels -> empty map, null values -> ''; zero times -> NULL."""
    return df.select(
        "*",
        no_null_values("a.labels").alias("labels"),
        no_null_values("a.annotations").alias("annotations"),
        zero_time_to_null(F.col("a.startsAt")).alias("starts_at"),
        zero_time_to_null(F.col("a.endsAt")).alias("ends_at"),
        F.col("a.generatorURL").alias("generator_url"),
    ).drop("a")


def file_ordinal(path: Column, number: str = FILE_NUMBER) -> Column:
    """Order of a file among those of its modification time, from its path alone: the last six digits of the number
    that the pattern ``number`` finds in its name (counters and time stamps of fixed width keep their order), then a
    digest of the path."""
    digits = F.regexp_extract(F.substring_index(path, "/", -1), number, 1)
    n = F.coalesce(F.right(digits, F.lit(_NUMBER_DIGITS)).try_cast("long"), F.lit(0))
    return F.shiftleft(n, _DIGEST_BITS) + F.pmod(F.xxhash64(path), F.lit(1 << _DIGEST_BITS))


def message_ordinal(offset: Column, partition: Column) -> Column:
    """Order of a message among those of its broker time: the offset (its low bits), then the partition."""
    low = F.pmod(offset.cast("long"), F.lit(1 << (_ORDINAL_BITS - _PARTITION_BITS)))
    return F.shiftleft(low, _PARTITION_BITS) + F.pmod(partition.cast("long"), F.lit(1 << _PARTITION_BITS))


def parse_batches(files: DataFrame, observed_at=None) -> tuple[DataFrame, DataFrame]:
    """S1 core over a DataFrame ``(path, mtime, value)`` of raw bodies.

    Returns ``(alerts, rejects)``. ``observed_at`` is the body's arrival
    time (file modification time) unless a time is given. ``seq`` orders
    pushes of equal arrival time: by the body's ``ordinal`` if ``files`` has
    that column (under 2**43), else by :func:`file_ordinal` of the path, then by
    array position. Bodies of more than 2**20 elements are rejected.
    """
    # every text that is a value gets an "s" in front, so the first character of a value tells its kind; the end mark,
    # which no text of the body can equal, shows that nothing follows the body
    marked = F.concat(F.lit("["), F.regexp_replace("value", _TEXT_VALUE, "$1s$2"), F.lit(',"end"]'))
    ordinal = F.col("ordinal") if "ordinal" in files.columns else file_ordinal(F.col("path"))
    parsed = files.select("path", "mtime", ordinal.alias("_ordinal"), F.from_json(marked, "array<string>", _STRICT).alias("_b"))
    body = F.get("_b", F.lit(0))
    whole = F.coalesce((F.size("_b") == 2) & (F.get("_b", F.lit(1)) == "end") & (body.isNull() | body.startswith("[")), F.lit(False))
    elems = F.when(whole & body.isNotNull(), F.from_json(body, "array<string>", _STRICT)).otherwise(F.array().cast("array<string>"))
    parsed = parsed.select("path", "mtime", "_ordinal", whole.alias("_whole"),
                           F.transform(elems, lambda e: F.struct(e.alias("raw"), _folded(_fields(e)).alias("fields"))).alias("_e"))
    valid = F.col("_whole") & F.forall("_e", _valid_element) & (F.size("_e") <= _MAX_ELEMENTS)
    parsed = parsed.select("path", "mtime", "_ordinal", F.coalesce(valid, F.lit(False)).alias("_ok"), "_e")
    rejects = parsed.where(~F.col("_ok")).select("path", F.lit("malformed alert batch").alias("error"))
    # the outer form and the late filter keep the optimiser from parsing once more for a filter before the explode
    exploded = parsed.select("path", "mtime", "_ordinal", F.posexplode_outer(F.when(F.col("_ok"), F.col("_e"))).alias("pos", "_x"))
    out = _normalise(exploded.where(F.col("pos").isNotNull()).select("path", "mtime", "_ordinal", "pos", _typed(F.col("_x.fields")).alias("a")))
    obs = F.col("mtime") if observed_at is None else F.lit(observed_at).cast("timestamp")
    return (out.select(
        F.xxhash64("path", "pos").alias("alert_id"),
        obs.alias("observed_at"),
        (F.col("_ordinal") * F.lit(_MAX_ELEMENTS) + F.col("pos")).alias("seq"),
        "labels", "annotations", "starts_at", "ends_at", "generator_url"),
        rejects)


def _fields(text: Column) -> Column:
    """Entries (name, value text) of a JSON object in their order, repeated names included; NULL for other values."""
    return F.when(text.startswith("{"), F.map_entries(F.from_json(text, "map<string,string>", _STRICT)))


def _folded(fields: Column) -> Column:
    """Fields with names in lower case; the long s counts as s."""
    return F.transform(fields, lambda x: F.struct(F.lower(F.translate(x["key"], "\u017f", "s")).alias("key"), x["value"].alias("value")))


def _named(fields: Column, name: str) -> Column:
    return F.filter(fields, lambda x: x["key"] == name.lower())


def _is_text(value: Column) -> Column:
    return value.isNull() | value.startswith("s")


def _valid_element(x: Column) -> Column:
    """What a typed decode of one alert accepts: an object (or null) whose labels and annotations are objects of texts
    or nulls, whose times are null or texts of a known form, and whose generatorURL is a text or null."""
    fields = x["fields"]

    def texts(name):
        return F.forall(_named(fields, name), lambda f: f["value"].isNull() | (f["value"].startswith("{") & F.coalesce(
            F.forall(_fields(f["value"]), lambda y: _is_text(y["value"])), F.lit(False))))

    def times(name):
        return F.forall(_named(fields, name), lambda f: f["value"].isNull() | (
            f["value"].startswith("s") & _posted_time(F.substr(f["value"], F.lit(2))).isNotNull()))

    return x["raw"].isNull() | F.coalesce(
        texts("labels") & texts("annotations") & times("startsAt") & times("endsAt")
        & F.forall(_named(fields, "generatorURL"), lambda f: _is_text(f["value"])), F.lit(False))


def _posted_time(text: Column) -> Column:
    """The instant of a time text; NULL if its form is unknown or there is no such time."""
    date, minutes, seconds, fraction, zone = (F.regexp_extract(text, _TIME_PARTS, i) for i in range(1, 6))
    full = F.concat(date, F.lit("T"), F.when(minutes == "", "00:00").otherwise(minutes),
                    F.when(seconds == "", ":00").otherwise(seconds), fraction,
                    F.when(zone == "", "Z").otherwise(F.regexp_replace(zone, r"^(...)(\d\d)$", "$1:$2")))
    return (F.when(text.rlike(_RFC3339), F.try_to_timestamp(text)).when(text == "", F.timestamp_seconds(F.lit(0)))
            .when(text.rlike(f"^(?:{_TIME_FORMS})$"), F.try_to_timestamp(full)))


def _typed(fields: Column) -> Column:
    """The alert of a valid element's fields; an element ``null`` is an alert without labels."""
    none = F.array().cast("array<struct<key:string,value:string>>")

    def labels(name):
        merged = F.aggregate(_named(fields, name), none, lambda acc, f: F.when(f["value"].isNull(), none).otherwise(
            F.concat(acc, F.coalesce(_fields(f["value"]), none))))
        placed = F.array_sort(F.transform(merged, lambda y, i: F.struct(y["key"].alias("key"), i.alias("i"), y["value"].alias("value"))))
        # a one-element array names the sorted entries, so that they are made once and not once per entry
        last = F.transform(F.array(placed), lambda p: F.filter(p, lambda y, i: ~y["key"].eqNullSafe(F.get(p, i + 1)["key"])))
        return F.map_from_entries(F.transform(F.get(last, F.lit(0)), lambda y: F.struct(y["key"], F.substr(y["value"], F.lit(2)))))

    def time(name):
        given = F.filter(_named(fields, name), lambda f: f["value"].isNotNull())
        return _posted_time(F.substr(F.get(given, F.size(given) - 1)["value"], F.lit(2)))

    url = _named(fields, "generatorURL")
    return F.struct(labels("labels").alias("labels"), labels("annotations").alias("annotations"),
                    time("startsAt").alias("startsAt"), time("endsAt").alias("endsAt"),
                    F.substr(F.get(url, F.size(url) - 1)["value"], F.lit(2)).alias("generatorURL"))


def _bodies(reader_df: DataFrame) -> DataFrame:
    return reader_df.select(F.col("_metadata.file_path").alias("path"),
                            F.col("_metadata.file_modification_time").alias("mtime"), "value")


def read_alert_batches(spark: SparkSession, path: str, observed_at=None) -> tuple[DataFrame, DataFrame]:
    """A directory (or glob) of JSON-array bodies, one body per file.
    Files of equal modification time count in the order of :func:`file_ordinal`,
    as they do in :func:`read_alert_stream`."""
    return parse_batches(_bodies(spark.read.option("wholetext", "true").text(path)), observed_at)


def read_alert_file(spark: SparkSession, path: str) -> DataFrame:
    """Single-object alert files (one JSON object per file)."""
    df = spark.read.schema(schemas.POSTABLE_ALERT).option("multiLine", "true").json(path)
    df = df.select(F.struct(*df.columns).alias("a"), F.input_file_name().alias("path"))
    return _normalise(df).select(
        F.xxhash64("path").alias("alert_id"), "labels", "annotations", "starts_at", "ends_at", "generator_url")


def read_alert_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None):
    """S3: continuous ingestion from a directory of JSON-array bodies.

    Every new file is one posted batch; the same parse as S1 runs on each
    micro-batch and gives each alert the same ``observed_at`` and ``seq`` as a
    batch read of the file. Returns ``(alerts, rejects)`` streams.
    """
    r = spark.readStream.option("wholetext", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return parse_batches(_bodies(r.text(path)))


def kafka_bodies(raw: DataFrame) -> DataFrame:
    """Kafka rows (topic, partition, offset, timestamp, value) as bodies for :func:`parse_batches`. Messages of one
    broker time count by offset, then partition, so equal offsets of two partitions differ."""
    return raw.select(F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("path"),
                      message_ordinal(F.col("offset"), F.col("partition")).alias("ordinal"),
                      F.col("timestamp").alias("mtime"), F.col("value").cast("string").alias("value"))


def read_alert_kafka(spark: SparkSession, bootstrap_servers: str, topic: str, **options):
    """S3, production form: one posted batch per Kafka message. Needs the
    Kafka connector on the classpath; the parse is the same as S1 with the
    broker timestamp as arrival time."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers)
         .option("subscribe", topic))
    for k, v in options.items():
        r = r.option(k, v)
    return parse_batches(kafka_bodies(r.load()))


def read_mutes(spark: SparkSession, path: str) -> DataFrame:
    """Mutes; NULL comment / created_by and NULL matcher values read as ''."""
    df = spark.read.schema(schemas.MUTES).parquet(path)
    return df.withColumn("matchers", no_null_values("matchers")).withColumn("comment", F.coalesce("comment", F.lit(""))) \
             .withColumn("created_by", F.coalesce("created_by", F.lit("")))


def mutes_from_jsonb(df: DataFrame, matchers_col: str = "matchers") -> DataFrame:
    """S4 for a JDBC-style source whose matchers are JSON text."""
    return df.withColumn(matchers_col, no_null_values(F.from_json(matchers_col, "map<string,string>")))


def read_notifications(spark: SparkSession, path: str) -> DataFrame:
    """The last-attempt snapshot."""
    return spark.read.schema(schemas.NOTIFICATIONS).parquet(path)
