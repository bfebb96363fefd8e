"""Label-map column functions.

All of them are built from Catalyst expressions; nothing here runs Python per
row. Label sets are ``map<string,string>`` columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertflow.session import materialize

# Fixed values of the fingerprint algorithm (64-bit FNV-1a over the sorted
# label pairs, each name and value followed by the separator byte 0xFF).
FNV64_OFFSET_HI = 3421674724          # 0xcbf29ce4
FNV64_OFFSET_LO = 2216829733          # 0x84222325
FNV64_PRIME_LOW = 435                 # prime = 2**40 + 435
EMPTY_FINGERPRINT = "cbf29ce484222325"
LABEL_SEPARATOR_HEX = "FF"
MASK32 = 4294967295


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- matching

def match_all(conditions, labels) -> Column:
    """every condition equals the label, an absent label reads as ''.

    An empty (or NULL) condition map is a catch-all. A NULL value, in a
    condition or a label, reads as ''.
    """
    conds, labs = _col(conditions), _col(labels)
    return F.coalesce(
        F.forall(F.map_entries(conds),
                 lambda e: F.coalesce(labs[e["key"]], F.lit("")) == F.coalesce(e["value"], F.lit(""))),
        F.lit(True))


def labels_contain(labels, matchers) -> Column:
    """strict containment (JSON ``@>``): the key must be present. A NULL
    value of a present key reads as '', as in F1."""
    labs, m = _col(labels), _col(matchers)
    return F.coalesce(
        F.forall(F.map_entries(m),
                 lambda e: F.coalesce(present_value(labs, e["key"]) == F.coalesce(e["value"], F.lit("")), F.lit(False))),
        F.lit(True))


def present_value(labels, key) -> Column:
    """The label's value, '' if it is NULL; NULL only if the key is absent."""
    labs = _col(labels)
    return F.coalesce(labs[key], F.when(F.map_contains_key(labs, key), F.lit("")))


def no_null_values(labels) -> Column:
    """NULL map -> empty map, NULL values -> '' (what a JSON null label decodes to)."""
    labs = F.coalesce(_col(labels), F.create_map().cast("map<string,string>"))
    return F.transform_values(labs, lambda k, v: F.coalesce(v, F.lit(""))).cast("map<string,string>")


def literal_match_all(match: dict, labels) -> Column:
    """F1 for a rule known on the driver: a plain conjunction, codegen-able."""
    labs = _col(labels)
    cond = F.lit(True)
    for k in sorted(match):
        cond = cond & (F.coalesce(labs[F.lit(k)], F.lit("")) == F.lit(match[k] or ""))
    return cond


# ---------------------------------------------------------------- canonical text

def sorted_entries(labels) -> Column:
    """Entries sorted by key (byte order, as Go's sort.Strings). Also the
    join key of a label set: equal maps give equal arrays. A NULL map gives
    the empty array and a NULL value '', so no row is lost in a join on it."""
    return F.sort_array(F.map_entries(no_null_values(labels)))


def label_hex(labels) -> Column:
    """The exact byte string the fingerprint hashes, as upper-case hex.

    Hex of ``name 0xFF value 0xFF`` per sorted label; 0xFF never occurs in
    UTF-8, so the text is an injective key of the label set.
    """
    return label_hex_of_entries(sorted_entries(labels))


def label_hex_of_entries(entries) -> Column:
    """:func:`label_hex` for already sorted ``array<struct<key,value>>``."""
    return F.array_join(
        F.transform(_col(entries),
                    lambda e: F.concat(F.hex(F.encode(e["key"], "UTF-8")), F.lit(LABEL_SEPARATOR_HEX),
                                       F.hex(F.encode(e["value"], "UTF-8")), F.lit(LABEL_SEPARATOR_HEX))),
        "")


def fingerprint_from_hex(hexstr) -> Column:
    """F3 core: 64-bit FNV-1a over hex-encoded bytes, 16 lower-case hex digits.

    Two 32-bit limbs keep every product below 2**43, so ANSI overflow
    checks never fire.
    """
    h = _col(hexstr)
    n_bytes = (F.length(h) / 2).cast("int")
    byte_vals = F.transform(
        F.sequence(F.lit(0), n_bytes - 1),
        lambda i: F.conv(F.substring(h, i * 2 + 1, 2), 16, 10).cast("long"))

    def step(acc, b):
        x = acc["lo"].bitwiseXOR(b)
        p = x * FNV64_PRIME_LOW
        lo = p.bitwiseAND(F.lit(MASK32))
        hi = (acc["hi"] * FNV64_PRIME_LOW + F.shiftright(p, 32) + F.shiftleft(x, 8)).bitwiseAND(F.lit(MASK32))
        return F.struct(hi.alias("hi"), lo.alias("lo"))

    init = F.struct(F.lit(FNV64_OFFSET_HI).cast("long").alias("hi"),
                    F.lit(FNV64_OFFSET_LO).cast("long").alias("lo"))
    acc = F.aggregate(byte_vals, init, step)
    digits = F.concat(F.lpad(F.lower(F.hex(acc["hi"])), 8, "0"),
                      F.lpad(F.lower(F.hex(acc["lo"])), 8, "0"))
    return F.when(F.length(h) == 0, F.lit(EMPTY_FINGERPRINT)).otherwise(digits)


def fingerprint(labels) -> Column:
    """F3 per row. Prefer :func:`with_fingerprint`, which hashes each
    distinct label set once."""
    return fingerprint_from_hex(label_hex(labels))


# A side table is broadcast up to this many bytes (its rows as JSON text and a
# fixed cost per row); a larger one is joined by a shuffle. Text counts at its
# length, so long labels cannot make the broadcast grow unseen.
BROADCAST_MAX_BYTES = 64 << 20
# Label sets as a share of the rows above which each row is hashed in place.
NEAR_UNIQUE = 0.5
_ROW_BYTES = 100


def side_bytes(columns: list[str]) -> Column:
    """Aggregate: measured size of a side table."""
    return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*columns))) + F.lit(_ROW_BYTES)), F.lit(0))


def broadcast_if_small(side: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES, n_bytes: int | None = None) -> DataFrame:
    """``side`` (already materialised, so that measuring it is one cheap aggregate) with a broadcast hint if its
    measured bytes allow it. ``n_bytes`` is that measure if the caller has it."""
    if n_bytes is None:
        n_bytes = side.agg(side_bytes(side.columns)).first()[0]
    return F.broadcast(side) if n_bytes <= max_bytes else side


def label_set_rows(df: DataFrame, labels: str = "labels", out: str = "fingerprint") -> DataFrame:
    """:func:`fingerprint_table` before it is checkpointed."""
    return (df.groupBy(sorted_entries(labels).alias("_lkey")).agg(F.count(F.lit(1)).alias("_n"))
            .select("_lkey", fingerprint_from_hex(label_hex_of_entries("_lkey")).alias(out), "_n"))


def fingerprint_table(df: DataFrame, labels: str = "labels", out: str = "fingerprint") -> DataFrame:
    """The distinct label sets of ``df`` with their F3 fingerprint and number of rows:
    ``(_lkey, fingerprint, _n)``, where ``_lkey`` is the sorted entry array.

    Distinct is aggregated map-side (partial aggregation) and the hash runs
    once per label set. The table is checkpointed (lineage cut, survives
    executor loss), so its size is known before anyone broadcasts it.
    """
    return materialize(label_set_rows(df, labels, out))


def with_fingerprint(df: DataFrame, labels: str = "labels", out: str = "fingerprint",
                     broadcast_max_bytes: int = BROADCAST_MAX_BYTES,
                     table: DataFrame | None = None, carry: tuple = (), table_bytes: int | None = None) -> DataFrame:
    """Add the F3 fingerprint, hashing each distinct label set once, or each row where label sets hardly repeat.

    The table of :func:`fingerprint_table` is broadcast only when its measured
    bytes are under ``broadcast_max_bytes``; otherwise both sides shuffle on
    the key. ``carry`` names further columns of ``table`` to bring along,
    ``table_bytes`` is the table's :func:`side_bytes` if already measured.

    A table of nearly as many label sets as rows saves no hash and costs a shuffle of all label maps. So, without a
    table, one scan estimates the number of label sets first, and above ``NEAR_UNIQUE`` of the rows each row is hashed
    in place: no shuffle, no checkpoint. A given table that is too large to broadcast is left aside by the same rule
    if it has row counts and nothing is carried. Both ways give the same values.
    """
    if table is None and not carry:
        n, sets = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(sorted_entries(labels)))).first()
        if sets > NEAR_UNIQUE * n:
            return df.withColumn(out, fingerprint(labels))
    dim = (table if table is not None else fingerprint_table(df, labels, out)).select("_lkey", out, *carry)
    if table is not None and not carry and "_n" in table.columns:
        measured, sets, n = table.agg(side_bytes(dim.columns), F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
        if measured > broadcast_max_bytes and sets > NEAR_UNIQUE * n:
            return df.withColumn(out, fingerprint(labels))
        table_bytes = measured
    keyed = df.withColumn("_lkey", sorted_entries(labels))
    return keyed.join(broadcast_if_small(dim, broadcast_max_bytes, table_bytes), "_lkey", "inner").drop("_lkey")


# ---------------------------------------------------------------- formatting

# Printable runes for %q (letters, marks, numbers, punctuation,
# symbols and the ASCII space) and the single-letter escapes.
_PRINTABLE = r"[\p{L}\p{M}\p{N}\p{P}\p{S} ]"
_LETTER_ESCAPES = [(7, "\\a"), (8, "\\b"), (12, "\\f"), (10, "\\n"), (13, "\\r"), (9, "\\t"), (11, "\\v")]


def _quote_rune(ch: Column) -> Column:
    cp = F.ascii(ch)  # the code point of the one-character string
    out = (F.when(ch == "\\", F.lit("\\\\")).when(ch == '"', F.lit('\\"'))
           .when(ch.rlike("^" + _PRINTABLE + "$"), ch))
    for code, esc in _LETTER_ESCAPES:
        out = out.when(cp == code, F.lit(esc))
    return (out.when((cp < 32) | (cp == 127), F.format_string("\\x%02x", cp))
            .when(cp < 65536, F.format_string("\\u%04x", cp))
            .otherwise(F.format_string("\\U%08x", cp)))


def _go_quote(c: Column) -> Column:
    """Go's %q: printable text only needs backslash and quote escaped; any
    other rune is escaped per code point (\\n, \\xNN, \\uNNNN, ...)."""
    fast = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', '\\\\"')
    slow = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), 0), _quote_rune), "")
    body = F.when(c.rlike("^" + _PRINTABLE + "*$"), fast).otherwise(slow)
    return F.concat(F.lit('"'), body, F.lit('"'))


def format_labels(labels) -> Column:
    """sorted ``k="v"`` joined by ``, `` (trace output)."""
    return F.array_join(
        F.transform(sorted_entries(labels), lambda e: F.concat(e["key"], F.lit("="), _go_quote(e["value"]))),
        ", ")


def format_matchers(matchers) -> Column:
    """sorted ``k=v`` joined by one space (matcher text box)."""
    return F.array_join(
        F.transform(sorted_entries(matchers), lambda e: F.concat(e["key"], F.lit("="), e["value"])),
        " ")


def parse_matchers_text(text) -> Column:
    """whitespace tokens ``k=v`` split at the first ``=``.

    Returns ``struct(matchers map, error string)``. A blank text, or a token
    whose ``=`` is first or last (or absent), is an error; the last duplicate
    key wins.
    """
    t = _col(text)
    # strings.Fields: split on Unicode white space
    tokens = F.filter(F.split(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""), r"(?U)\s+"), lambda s: F.length(s) > 0)
    pos = lambda s: F.instr(s, "=")
    bad = F.filter(tokens, lambda s: (pos(s) <= 1) | (pos(s) == F.length(s)))
    entries = F.transform(tokens, lambda s: F.struct(
        F.substring(s, 1, pos(s) - 1).alias("key"),
        F.substring(s, pos(s) + 1, 1 << 30).alias("value")))
    # keep the last occurrence of each key: reverse, drop later repeats
    rev = F.reverse(entries)
    keys_rev = F.transform(rev, lambda e: e["key"])
    dedup = F.filter(rev, lambda e, i: F.array_position(keys_rev, e["key"]) == i + 1)
    err = (F.when(t.isNull() | t.rlike(r"(?U)^\s*$"), F.lit("matchers must be non-empty"))
           .when(F.size(bad) > 0,
                 F.format_string('invalid matcher "%s": expected key=value', F.get(bad, 0))))
    m = F.when(err.isNull(), F.map_from_entries(F.reverse(dedup)))
    return F.struct(m.alias("matchers"), err.alias("error"))


# ---------------------------------------------------------------- lists and JSON

def same_multiset(a, b) -> Column:
    """equal as multisets (order ignored, duplicates count); NULL = []."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.coalesce(_col(a), empty)) == F.array_sort(F.coalesce(_col(b), empty))


def labels_from_json(text) -> Column:
    """JSON object text to ``map<string,string>``."""
    return F.from_json(_col(text), "map<string,string>")


def labels_to_json(labels) -> Column:
    """map to JSON object text with keys in sorted order (NULL stays NULL)."""
    return F.when(_col(labels).isNotNull(), F.to_json(F.map_from_entries(sorted_entries(labels))))
