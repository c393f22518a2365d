"""Raw lines -> typed log entries, as column expressions.

``parse_lines(df)`` takes any DataFrame with a ``value`` line column (batch or
streaming) and adds the entry columns plus ``parse_error`` (null when the
line parsed). Nothing here leaves the JVM: it is one projection that fuses
into the scan's whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import (
    GO_NON_SPACE,
    GO_SPACE,
    JSON_TYPED_KEYS,
    MAX_LINE_BYTES,
    REJECT_FORMAT,
    REJECT_JSON,
    REJECT_JSON_TYPE,
    REJECT_TIMESTAMP,
    REJECT_TOO_LONG,
)
from .text import go_trim, pinned
from .timestamps import timestamp_from_parts, timestamp_parts

# Key of the map appended after the object: only present at index 1 when the
# parser consumed exactly one object and nothing but white space after it.
_SENTINEL_KEY = "\u0001eol"
_SENTINEL_RAW = "\\u0001eol"
_JSON_OPTIONS = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "allowUnquotedFieldNames": "false",
    "allowComments": "false",
    "allowNumericLeadingZeros": "false",
    "allowBackslashEscapingAnyCharacter": "false",
    "allowUnquotedControlChars": "false",
    "mode": "PERMISSIVE",
}


def _plain(value: Column) -> dict[str, Column]:
    """``level [time] message k=v ...``."""
    p1 = F.instr(value, " [")
    level = go_trim(F.substring(value, F.lit(1), p1 - 1))
    rest = F.substring(value, p1 + 2, F.lit(1 << 30))
    p2 = F.instr(rest, "] ")
    raw_ts = F.substring(rest, F.lit(1), p2 - 1)
    body = F.substring(rest, p2 + 2, F.lit(1 << 30))
    return {"ok": (p1 > 0) & (p2 > 0), "level": level, "raw_ts": raw_ts, "body": body}


# A non-space run: the complement of GO_SPACE.
_NS = GO_NON_SPACE
# Start of a word containing '='.
_KV_WORD = "(?<!" + _NS + ")" + _NS[:-1] + "&&[^=]]*="
# key=value words other than caller / user_id; group 1 key, group 2 value.
_EXTRA_KV = "(?<!" + _NS + ")(?!caller=|user_id=)(" + _NS[:-1] + "&&[^=]]*)=(" + _NS + "*)"


def _last_value(body: Column, key: str) -> Column:
    """Value of the last ``key=`` word in ``body`` (null when absent)."""
    vals = F.regexp_extract_all(body, F.lit("(?<!" + _NS + ")" + key + "=(" + _NS + "*)"), 1)
    return F.try_element_at(vals, F.lit(-1))


def _plain_arrays(body: Column) -> dict[str, Column]:
    """Regex extractions of P3-P4, pinned once per row."""
    return {
        "kv_at": F.regexp_instr(body, F.lit(_KV_WORD)),
        "keys": F.regexp_extract_all(body, F.lit(_EXTRA_KV), 1),
        "values": F.regexp_extract_all(body, F.lit(_EXTRA_KV), 2),
        "caller": _last_value(body, "caller"),
        "user": _last_value(body, "user_id"),
    }


def _plain_fields(body: Column, arr: Column) -> dict[str, Column]:
    """P3-P4 from the pinned extractions (``arr`` = struct of ``_plain_arrays``);
    only a line with a repeated key takes the slower last-wins branch."""
    kv_at, keys, values = arr["kv_at"], arr["keys"], arr["values"]
    head = F.when(kv_at > 0, F.substring(body, F.lit(1), kv_at - 1)).otherwise(body)
    message = F.array_join(F.array_remove(F.split(head, f"{GO_SPACE}+"), ""), " ")
    last_first = F.array_distinct(F.reverse(keys))
    deduped = F.map_from_arrays(
        last_first,
        F.transform(
            last_first,
            lambda k: F.try_element_at(F.reverse(values), F.array_position(F.reverse(keys), k).cast("int")),
        ),
    )
    extras = F.when(F.size(last_first) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(deduped)
    return {
        "message": message,
        "source": F.coalesce(F.regexp_replace(arr["caller"], '^"+|"+$', ""), F.lit("")),
        "user": F.coalesce(arr["user"], F.lit("")),
        "extras": extras,
    }


_TYPED_LOWER = tuple(k.lower() for k in JSON_TYPED_KEYS)
_KEY_SEP = "\u0001"
_TYPED_EXACT_RE = "(?:^|\\x{01})(?:" + "|".join(JSON_TYPED_KEYS) + ")(?=\\x{01}|$)"
_TYPED_LOWER_RE = "(?:^|\\x{01})(?:" + "|".join(_TYPED_LOWER) + ")(?=\\x{01}|$)"


def number_text(text: Column) -> Column:
    """A JSON number as extras text: shortest digits, in full from 1e-6 up to
    1e21, else with an exponent (``1e-7``, ``1e+21``); plain integers keep all
    their digits."""
    s = text.cast("double").cast("string")
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    shape = r"^-?(\d+)\.(\d+)E(-?\d+)$"
    digits = F.regexp_replace(F.concat(F.regexp_extract(s, shape, 1), F.regexp_extract(s, shape, 2)), "0+$", "")
    exp = F.regexp_extract(s, shape, 3).try_cast("int")
    rest = F.substring(digits, F.lit(2), F.length(digits))
    full = F.when(F.length(digits) <= exp + 1, F.rpad(digits, exp + 1, F.lit("0"))).otherwise(
        F.concat(F.substring(digits, F.lit(1), exp + 1), F.lit("."), F.substring(digits, exp + 2, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-exp - 1, F.lit(0))), digits)
    scientific = F.concat(
        F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")),
        F.when(exp > 0, F.lit("e+")).otherwise(F.lit("e-")), F.abs(exp).cast("string"))
    return (
        F.when(text.rlike(r"^-?\d+$"), text)
        .when(exp.isNull(), F.regexp_replace(s, r"\.0$", ""))
        .when((exp >= 21) | (exp < -6), F.concat(sign, scientific))
        .when(exp >= 0, F.concat(sign, full))
        .otherwise(F.concat(sign, small))
    )


# Strings, numbers and what stands between them.
_JSON_PIECES = r'"(?:[^"\\]|\\.)*+"|-?\d[\d.eE+-]*+|[^"\d-]++'


def _variant_text(v: Column) -> Column:
    """A JSON value as extras text: strings as is, everything else as compact
    JSON (object keys sorted), numbers as in ``number_text``."""
    kind = F.schema_of_variant(v)
    text = F.to_json(v)
    pieces = F.transform(
        F.regexp_extract_all(text, F.lit(_JSON_PIECES), 0),
        lambda t: F.when(t.rlike(r"^-?\d"), number_text(t)).otherwise(t),
    )
    return (
        F.when(kind == "STRING", v.cast("string"))
        .when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), number_text(text))
        .when((kind.startswith("OBJECT") | kind.startswith("ARRAY")) & text.rlike(r"\d[.eE]"), F.array_join(pieces, ""))
        .otherwise(text)
    )


def json_array(value: Column) -> Column:
    """The line parsed as ``[object, sentinel]`` (null when not JSON)."""
    return F.from_json(
        F.concat(F.lit("["), value, F.lit(',{"' + _SENTINEL_RAW + '":0}]')),
        "array<map<string,variant>>",
        _JSON_OPTIONS,
    )


def _exact_keys(arr: Column) -> Column:
    """True when no key is repeated and typed keys are spelled exactly (the fast path)."""
    joined = F.array_join(F.map_keys(F.try_element_at(arr, F.lit(1))), _KEY_SEP)
    return ~_repeats(arr) & (F.regexp_count(joined, F.lit(_TYPED_EXACT_RE)) == F.regexp_count(
        F.lower(joined), F.lit(_TYPED_LOWER_RE)
    ))


def _repeats(arr: Column) -> Column:
    """True when a key of the object occurs more than once (the last one counts)."""
    keys = F.map_keys(F.try_element_at(arr, F.lit(1)))
    return F.size(keys) != F.size(F.array_distinct(keys))


def _json(value: Column, arr: Column) -> dict[str, Column]:
    """One JSON object per line, strict syntax, typed keys must be strings.

    ``arr`` is ``json_array(value)``, computed in an earlier stage so lambdas
    below do not re-parse the line. Fast path: typed keys appear with their
    exact spelling, so each is one map lookup. A line with an odd-cased typed
    key (matched too, as in the original) or a repeated key takes the slower
    per-entry branch, where the last one counts."""
    syntax_ok = (
        arr.isNotNull()
        & (F.size(arr) == 2)
        & F.array_contains(F.map_keys(F.try_element_at(arr, F.lit(2))), _SENTINEL_KEY)
        & ~value.contains(_SENTINEL_RAW)
    )
    obj = F.try_element_at(arr, F.lit(1))
    keys = F.map_keys(obj)
    exact = F.col("_exact")
    entries = F.map_entries(obj)

    def typed(name: str) -> Column:
        v = F.try_element_at(obj, F.lit(name))
        fast = F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))
        hits = F.filter(
            entries,
            lambda e: (F.lower(e["key"]) == name.lower())
            & (F.schema_of_variant(e["value"]) == "STRING"),
        )
        slow = F.try_element_at(hits, F.lit(-1))["value"].cast("string")
        return F.coalesce(F.when(exact, fast).otherwise(slow), F.lit(""))

    def bad(name: str) -> Column:
        v = F.try_element_at(obj, F.lit(name))
        return v.isNotNull() & ~F.schema_of_variant(v).isin("STRING", "VOID")

    fast_bad = bad(JSON_TYPED_KEYS[0])
    for k in JSON_TYPED_KEYS[1:]:
        fast_bad = fast_bad | bad(k)
    slow_bad = F.exists(
        entries,
        lambda e: F.lower(e["key"]).isin(*_TYPED_LOWER)
        & ~F.schema_of_variant(e["value"]).isin("STRING", "VOID"),
    )
    extra_keys = F.array_except(keys, F.array(*[F.lit(k) for k in JSON_TYPED_KEYS]))
    last_keys, last_values = F.reverse(keys), F.reverse(F.map_values(obj))
    extras = F.map_from_arrays(
        extra_keys,
        F.transform(
            extra_keys,
            lambda k: _variant_text(
                F.when(F.col("_repeats"), F.try_element_at(last_values, F.array_position(last_keys, k).cast("int")))
                .otherwise(F.try_element_at(obj, k))),
        ),
    )
    return {
        "ok": syntax_ok,
        "bad_type": F.when(exact, F.coalesce(fast_bad, F.lit(False))).otherwise(slow_bad),
        "raw_ts": typed("timestamp"),
        "level": typed("level"),
        "message": typed("msg"),
        "source": typed("caller"),
        "user": typed("user_id"),
        "log_source": typed("logSource"),
        "ack_id": typed("ackId"),
        "type": typed("type"),
        "status": typed("status"),
        "extras": extras,
    }


def parse_lines(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Add entry columns and ``parse_error`` to a frame of raw lines.

    Stages are pinned so every regex / JSON parse runs once per row: values
    used inside CASE branches are not shared by subexpression elimination."""
    value = F.col(value_col)
    base = df.columns
    # a repeated key inside a nested object is no error either; the last one counts
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    staged = pinned(
        df,
        _too_long=F.octet_length(value) >= MAX_LINE_BYTES,
        _is_json=value.startswith("{") | value.rlike(f"^{GO_SPACE}+\\{{"),
    )
    json_line = ~F.col("_too_long") & F.col("_is_json")
    plain_line = ~F.col("_too_long") & ~F.col("_is_json")
    p = _plain(value)
    staged = pinned(
        staged,
        _arr=F.when(json_line, json_array(value)),
        _p=F.when(plain_line, F.struct(*[c.alias(k) for k, c in p.items()])),
    )
    pa = _plain_arrays(F.col("_p.body"))
    staged = pinned(
        staged,
        _exact=F.when(json_line, _exact_keys(F.col("_arr"))),
        _repeats=F.when(json_line, _repeats(F.col("_arr"))),
        _pa=F.when(F.col("_p.ok"), F.struct(*[c.alias(k) for k, c in pa.items()])),
    )
    j = _json(value, F.col("_arr"))
    json_fields = ("level", "message", "source", "user", "log_source", "ack_id", "type", "status")
    pf = _plain_fields(F.col("_p.body"), F.col("_pa"))
    staged = pinned(
        staged,
        _j=F.when(
            json_line,
            F.struct(
                j["ok"].alias("ok"), j["bad_type"].alias("bad_type"),
                *[j[k].alias(k) for k in json_fields],
                j["extras"].alias("extras"),
            ),
        ),
        _pf=F.when(F.col("_p.ok"), F.struct(*[c.alias(k) for k, c in pf.items()])),
        _tsp=F.when(json_line, timestamp_parts(j["raw_ts"], trim=True))
        .when(F.col("_p.ok"), timestamp_parts(F.col("_p.raw_ts"))),
    )
    staged = pinned(staged, _t=timestamp_from_parts(F.col("_tsp")))
    err = (
        F.when(F.col("_too_long"), F.lit(REJECT_TOO_LONG))
        .when(F.col("_is_json") & ~F.col("_j.ok"), F.lit(REJECT_JSON))
        .when(F.col("_is_json") & F.col("_j.bad_type"), F.lit(REJECT_JSON_TYPE))
        .when(~F.col("_is_json") & ~F.col("_p.ok"), F.lit(REJECT_FORMAT))
        .when(F.col("_t").isNull(), F.lit(REJECT_TIMESTAMP))
    )
    js = F.col("_is_json")

    def pick(name: str, plain: Column) -> Column:
        return F.when(js, F.col(f"_j.{name}")).otherwise(plain).alias(name)

    empty = F.lit("")
    return staged.select(
        *base,
        F.col("_t.ts").alias("ts"),
        F.col("_t.wall_ts").alias("wall_ts"),
        F.col("_t.tz_offset").alias("tz_offset"),
        pick("level", F.col("_p.level")),
        pick("message", F.col("_pf.message")),
        pick("source", F.col("_pf.source")),
        pick("user", F.col("_pf.user")),
        pick("log_source", empty),
        pick("ack_id", empty),
        pick("type", empty),
        pick("status", empty),
        pick("extras", F.col("_pf.extras")),
        F.lit(0).cast("bigint").alias("duplicate_count"),
        F.when(js, F.lit("json")).otherwise(F.lit("plain")).alias("line_format"),
        err.alias("parse_error"),
    )
