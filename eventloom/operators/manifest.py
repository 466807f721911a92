"""Rule checks and defaults for tables of run-manifest entries.

An entry is a VARIANT ``{name, settings{...}}``; a manifest document is a JSON
array of entries. Wrong types are the very subject here, so entries stay VARIANT
until a rule has looked at them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.jsontext import is_array_text, parse_document
from eventloom.functions.options import option_map
from eventloom.functions.scalars import integer_convertible, to_integer

# Integer settings with the default each one has.
INTEGER_DEFAULTS = {
    "target_delay": 0,
    "exploit_retries": 4,
    "exploit_check_delay": 3,
    "exploit_check_count": 7,
    "ready_delay": 5,
    "ready_retries": 5,
}

# Text settings checked in one rule, and the allowed modes.
TEXT_SETTINGS = ("exploit_options", "exploit_success_pattern")
MODES = ("cli", "rpc")
DEFAULT_MODE = "cli"
DEFAULT_PATTERN = "4444"

# Every setting a rule looks at.
SETTINGS = (
    "description",
    "exploit",
    "target_image",
    "yml_file",
    "target_name",
    *INTEGER_DEFAULTS,
    *TEXT_SETTINGS,
    "exploit_mode",
)

NOT_JSON = "Invalid JSON in configuration file."
NOT_AN_ARRAY = "Config must be a non-empty JSON array of objects."


def read_entries(documents: DataFrame, text: str = "value") -> DataFrame:
    """Entries of manifest documents.

    Adds ``valid_json``, ``entry_no`` (from 1) and ``entry`` (VARIANT) to the other
    columns. A document that is no non-empty array gives one row with the last two
    null.
    """
    others = [c for c in documents.columns if c != text]
    parsed = documents.select(
        *others, is_array_text(F.col(text)).alias("_array"), parse_document(F.col(text)).alias("_doc")
    )
    elements = F.when(F.col("_array"), F.try_variant_get("_doc", "$", "array<variant>"))
    return parsed.select(
        *others,
        F.col("_doc").isNotNull().alias("valid_json"),
        F.posexplode_outer(elements).alias("_pos", "entry"),
    ).select(*others, "valid_json", (F.col("_pos") + 1).alias("entry_no"), "entry")


def _kind_word(kind: Column) -> Column:
    """Type name as in messages, from a VARIANT schema text."""
    return (
        F.when(kind == "STRING", "str")
        .when(kind == "BIGINT", "int")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "VOID", "NoneType")
        .when(kind.startswith("ARRAY"), "list")
        # Whole numbers too large for a bigint show as decimals without a fraction.
        .when(kind.rlike(r"^DECIMAL\(\d+,0\)$"), "int")
        .otherwise("float")
    )


def _value(key: str) -> Column:
    return F.col(f"_value_{key}")


def _type(key: str) -> Column:
    return F.col(f"_type_{key}")


def _inspect(entries: DataFrame) -> DataFrame:
    """Take every entry apart once: values first, then their types."""
    paths = {"name": "$.name", "settings": "$.settings"}
    paths |= {key: f"$.settings.{key}" for key in SETTINGS}
    values = entries.withColumns(
        {f"_value_{k}": F.try_variant_get("entry", p, "variant") for k, p in paths.items()}
    )
    types = {f"_type_{k}": F.coalesce(F.schema_of_variant(_value(k)), F.lit("")) for k in paths}
    return values.withColumns(
        {**types, "_type": F.coalesce(F.schema_of_variant("entry"), F.lit(""))}
    )


def _rules(strict: bool) -> list[tuple[str, Column, Column]]:
    """(rule, condition, message) in message order; conditions are never null.

    The type of an absent value is the empty text.
    """
    is_object = F.col("_type").startswith("OBJECT")
    settings_object = is_object & _type("settings").startswith("OBJECT")

    bare = F.concat(F.lit("Entry "), F.col("entry_no").cast("string"))
    named = F.when(
        _type("name") == "STRING",
        F.concat(bare, F.lit(" ('"), F.try_variant_get(_value("name"), "$", "string"), F.lit("')")),
    ).otherwise(bare)

    def say(text: str, prefix: Column = named) -> Column:
        return F.concat(prefix, F.lit(": " + text))

    no_entry = F.col("entry_no").isNull()
    rules = [
        ("V0", ~F.col("valid_json"), F.lit(NOT_JSON)),
        ("V1", F.col("valid_json") & no_entry, F.lit(NOT_AN_ARRAY)),
        (
            "V2",
            ~no_entry & ~is_object,
            F.concat(bare, F.lit(": must be a JSON object, got "), _kind_word(F.col("_type")), F.lit(".")),
        ),
    ]

    def check(rule: str, condition: Column, text: str, where: Column = settings_object) -> None:
        rules.append((rule, where & condition, say(text)))

    def absent(key: str) -> Column:
        return _type(key) == ""

    def wrong_type(key: str) -> Column:
        return ~absent(key) & (_type(key) != "STRING")

    check("V3", absent("name"), "missing required field 'name'.", is_object)
    check("V4", wrong_type("name"), "'name' must be a string.", is_object)
    check("V5", absent("settings"), "missing required field 'settings'.", is_object)
    check(
        "V6",
        ~absent("settings") & ~settings_object,
        "'settings' must be a JSON object.",
        is_object,
    )

    image, compose = ~absent("target_image"), ~absent("yml_file")
    one_target = image != compose

    check("V7", absent("description"), "missing required setting 'description'.")
    check("V7", wrong_type("description"), "setting 'description' must be a string.")
    check("V8", wrong_type("exploit"), "setting 'exploit' must be a string.")
    check("V9", image & compose, "specify only one of 'target_image' or 'yml_file', not both.")
    check("V10", ~image & ~compose, "must specify either 'target_image' or 'yml_file'.")
    check("V11", one_target & wrong_type("target_image"), "'target_image' must be a string.")
    check("V11", one_target & wrong_type("yml_file"), "'yml_file' must be a string.")
    check(
        "V12",
        one_target & compose & absent("target_name"),
        "'target_name' is required when 'yml_file' is used.",
    )
    check("V12", one_target & compose & wrong_type("target_name"), "'target_name' must be a string.")
    for key in INTEGER_DEFAULTS:
        fits = F.coalesce(integer_convertible(_value(key), _type(key)), F.lit(True))
        check("V13", ~fits, f"'{key}' must be convertible to an integer.")
    for key in TEXT_SETTINGS:
        check("V14", wrong_type(key), f"'{key}' must be a string.")
    mode = F.try_variant_get(_value("exploit_mode"), "$", "string")
    known = (_type("exploit_mode") == "STRING") & F.coalesce(mode.isin(*MODES), F.lit(False))
    check("V15", ~absent("exploit_mode") & ~known, "'exploit_mode' must be 'cli' or 'rpc'.")
    if strict:
        extra = F.array_except(
            F.json_object_keys(F.to_json("entry")), F.array(F.lit("name"), F.lit("settings"))
        )
        unknown = F.array_join(F.array_sort(extra), ", ")
        rules.append(
            (
                "V16",
                is_object & (F.coalesce(F.size(extra), F.lit(0)) > 0),
                F.concat(named, F.lit(": unknown fields: "), unknown, F.lit(".")),
            )
        )
        for key in INTEGER_DEFAULTS:
            number = _type(key).rlike("^(BIGINT|DECIMAL.*|DOUBLE)$")
            below = F.coalesce(to_integer(_value(key), _type(key)) < 0, F.lit(False))
            check("V16", number & below, f"'{key}' must not be negative.")
            value = F.try_variant_get(_value(key), "$", "double")
            fraction = number & F.coalesce(value != F.rint(value), F.lit(False))
            odd = fraction | (_type(key) == "BOOLEAN")
            check("V16", odd, f"'{key}' must be an integer or a string.")
    return rules


def validate_manifest(entries: DataFrame, strict: bool = False) -> DataFrame:
    """Errors of manifest entries, in message order.

    Input: the columns of :func:`read_entries`; others are carried along. Output:
    those, ``entry_no``, ``seq`` (order within the entry), ``rule`` and
    ``message``; a valid entry gives no row. ``strict`` adds the checks only the
    published JSON schema makes (V16). Narrow: no shuffle.
    """
    found = [
        F.when(condition, F.struct(F.lit(rule).alias("rule"), message.alias("message")))
        for rule, condition, message in _rules(strict)
    ]
    others = _others(entries)
    return (
        _inspect(entries)
        .select(*others, F.posexplode(F.array_compact(F.array(*found))).alias("seq", "_error"))
        .select(*others, "seq", "_error.rule", "_error.message")
    )


def resolve_runs(entries: DataFrame) -> DataFrame:
    """The run table: one row per entry with every setting in place.

    Meant for valid entries. Integers given as text are converted, absent settings
    get their defaults (an integer beyond 64 bits is null, never the default),
    ``manual`` tells runs without an exploit, ``target_kind``
    is ``compose`` or ``docker``, and ``options`` is the option string as a map.
    """
    return _resolved(_inspect(entries), _others(entries))


def valid_runs(entries: DataFrame, strict: bool = False) -> DataFrame:
    """:func:`resolve_runs` of the entries without an error, in one narrow pass."""
    inspected = _inspect(entries)
    faults = [F.coalesce(condition, F.lit(False)) for _, condition, _ in _rules(strict)]
    sound = F.col("entry_no").isNotNull() & ~reduce(or_, faults)
    return _resolved(inspected.filter(sound), _others(entries))


def _others(entries: DataFrame) -> list[str]:
    return [c for c in entries.columns if c not in ("entry", "valid_json")]


def _resolved(inspected: DataFrame, others: list[str]) -> DataFrame:
    def text(key: str, default: str | None = None) -> Column:
        found = F.try_variant_get(_value(key), "$", "string")
        return found if default is None else F.coalesce(found, F.lit(default))

    return inspected.select(
        *others,
        F.try_variant_get(_value("name"), "$", "string").alias("cve_name"),
        text("description").alias("description"),
        text("exploit", "").alias("exploit"),
        text("target_image").alias("target_image"),
        text("yml_file").alias("yml_file"),
        text("target_name").alias("target_name"),
        text("exploit_options", "").alias("exploit_options"),
        option_map(text("exploit_options", "")).alias("options"),
        text("exploit_success_pattern", DEFAULT_PATTERN).alias("exploit_success_pattern"),
        text("exploit_mode", DEFAULT_MODE).alias("exploit_mode"),
        *(
            F.when(_type(key) == "", F.lit(default).cast("bigint"))
            .otherwise(to_integer(_value(key), _type(key)))
            .alias(key)
            for key, default in INTEGER_DEFAULTS.items()
        ),
        (text("exploit", "") == "").alias("manual"),
        F.when(_type("yml_file") != "", "compose").otherwise("docker").alias("target_kind"),
    )
