"""String expressions: clipping, templates, keys and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .masking import mask_json

# Widest text stored per column.
CLIP = {
    "channel": 64,
    "level_name": 20,
    "message": 65_535,
    "url": 2_000,
    "ip": 45,
    "path": 500,
    "template": 1_000,
    "command": 60,
}

# SQL template rules, applied in this order: line comments, block comments, string and
# number literals, lists, spaces. The string literal is written possessively so that one of any length
# is matched without recursion; what a literal starts with is looked at first, for speed.
SQL_TEMPLATE_RULES = (
    (r"--[^\n]*+", ""),
    (r"(?s)/\*.*?\*/", ""),
    (r"(?d)(?=['0-9])(?:'[^'\\]*+(?:\\.[^'\\]*+)*+'|\b\d+(?:\.\d+)?\b)", "?"),
    (r"(?i)IN\s*\(\s*\?(?:\s*,\s*\?)*+\s*\)", "IN (?)"),
    (r"\s+", " "),
)

# Characters a plain trim removes besides the space.
BLANKS = " \t\n\r\x00\x0b"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clip(value: Column | str, kind: str) -> Column:
    """First characters of the text, as many as the stored column holds."""
    return F.substring(as_col(value), 1, CLIP[kind])


def trim_blanks(value: Column | str) -> Column:
    return F.btrim(as_col(value), F.lit(BLANKS))


def empty_to_null(value: Column | str) -> Column:
    return F.nullif(as_col(value), F.lit(""))


def collapse_spaces(value: Column | str) -> Column:
    return F.regexp_replace(as_col(value), r"\s+", " ")


def sql_template(sql: Column | str) -> Column:
    """SQL text with comments dropped, literals replaced and IN lists collapsed, in full length: a
    stored column clips it only after statements were grouped by it."""
    c = F.coalesce(as_col(sql), F.lit(""))
    for pattern, replacement in SQL_TEMPLATE_RULES:
        c = F.regexp_replace(c, pattern, replacement)
    return F.trim(c)


def is_select(sql: Column | str) -> Column:
    return F.upper(F.ltrim(as_col(sql), F.lit(BLANKS))).startswith("SELECT")


def path_template(path: Column | str) -> Column:
    """``full_path_template`` as the stored column holds it."""
    return clip(full_path_template(path), "path")


def full_path_template(path: Column | str) -> Column:
    """Request path without its query string, numeric segments replaced by ``{id}``, in full length:
    endpoints are grouped by it and clipped afterwards."""
    c = as_col(path)
    bare = F.substring_index(c, "?", 1)
    # A path that is nothing but a query string is kept as it is.
    bare = F.when(bare == "", F.when(F.ltrim(c, F.lit("?")) == "", c).otherwise(
        F.substring_index(F.ltrim(c, F.lit("?")), "?", 1)
    )).otherwise(bare)
    return F.regexp_replace(bare, r"/\d+(?=/|\z)", "/{id}")


def request_url(path: Column | str, query: Column | str) -> Column:
    p, q = as_col(path), as_col(query)
    return F.when(F.length(q) > 0, F.concat(p, F.lit("?"), q)).otherwise(p)


def command_url(name: Column | str) -> Column:
    return F.concat(F.lit("cli:"), as_col(name))


def queue_topic(
    properties: Column | str, body: Column | str, keys: Sequence[str] = ("topic_name", "topic")
) -> Column:
    """Topic of a queue message: first filled property, else a hash of the body's start.

    Pass the broker's own property name first in ``keys`` where it has one.
    """
    props, text = as_col(properties), as_col(body)
    # "0" counts as empty, as it does for the writers of these properties.
    named = [
        F.when(~F.element_at(props, F.lit(k)).isin("", "0"), F.element_at(props, F.lit(k)))
        for k in keys
    ]
    return F.when(text.isNull(), F.lit("mq://unknown")).otherwise(
        F.coalesce(
            *[F.concat(F.lit("mq://"), n) for n in named],
            F.concat(F.lit("mq://body:"), F.md5(F.substring(text, 1, 80))),
        )
    )


def instance_id(hostname: Column | str, ip: Column | str) -> Column:
    return F.substring(F.md5(F.concat(as_col(hostname), as_col(ip))), 1, 12)


def kb_map(text: Column | str) -> Column:
    """``Key:  N kB`` lines as a map of key to N."""
    c = as_col(text)
    line = F.lit(r"(?m)^(\w+):\s+(\d+)\s+kB")
    keys = F.regexp_extract_all(c, line, F.lit(1))
    values = F.transform(F.regexp_extract_all(c, line, F.lit(2)), lambda x: x.cast("bigint"))
    # Of a repeated key the last value counts.
    pairs = F.filter(
        F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.greatest(F.size(keys), F.lit(1))).alias("i")),
        lambda p: p["k"].isNotNull(),
    )
    last = F.filter(
        pairs, lambda p: ~F.exists(pairs, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"]))
    )
    return F.map_from_arrays(F.transform(last, lambda p: p["k"]), F.transform(last, lambda p: p["v"]))


def message_key(
    channel: Column | str, level: Column | str, message: Column | str, length: int
) -> Column:
    """Grouping key of a record: channel, level and the message's first characters."""
    return F.md5(
        F.concat_ws(
            "|", as_col(channel), as_col(level).cast("string"), F.substring(as_col(message), 1, length)
        )
    )


def mask_params(params_json: Column | str) -> Column:
    """Parameters with the values of sensitive names masked, as JSON text; nothing else changes.

    Positional lists carry no names, so nothing in them is masked; a text that holds a sensitive word
    and can't be read is masked whole.
    """
    return mask_json(as_col(params_json))


def params_fingerprint(masked_json: Column | str) -> Column:
    """Hash of the parameters; white space between values does not count, the order of names does."""
    c = F.coalesce(as_col(masked_json), F.lit("null"))
    blank = F.regexp_replace(c, r'("(?:[^"\\]++|\\.)*+")|\s+', "$1")
    return F.md5(F.when(c.rlike(r"\s"), blank).otherwise(c))


def number_text(value: Column | str) -> Column:
    """A number as short text: 50.0 prints as 50."""
    return F.regexp_replace(as_col(value).cast("string"), r"\.0\z", "")
