"""Expressions over raw log lines: headers, exceptions, repeated text, search patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .levels import level_code
from .text import as_col, clip, trim_blanks

# Line formats. (?d) makes "." stop at \n only; (?U) makes classes Unicode-aware.
RECORD_HEADER = r"\A\s*+\[\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+[^\]]*\]\s+\w+\.\w+:\s+"
CARRIED_TIME = r"\A\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\]"
CARRIED_TIME_ANY = r"\A\[(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})[^\]]*\]"
LOOSE_STAMP = r"\A\[(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[^\]]*)\]\s*"
LOOSE_CHANNEL = r"\A([a-zA-Z0-9_\-]+)\.([A-Z]+):\s"
MINUTE_LABEL = r"\A\[\d{4}-\d{2}-\d{2} (\d{2}:\d{2})"
MINUTE_LABEL_ANY = r"\A\[\d{4}-\d{2}-\d{2}[T ](\d{2}:\d{2})"
MINUTE_START = r"\A\[(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})"

# An exception class: word and namespace characters ending in one of three suffixes.
# A leading backslash counts only if another one follows within the name. Written without a repetition
# inside another, for speed.
_CLASS = r"((?!\\\w*+(?!\\))[\w\\]*\w(?:Exception|Error|Throwable))"
_CODE = r"(?:\(code:[^)]*\))?"
EXCEPTION_OBJECT = (
    r"(?U)(?d)\[object\]\s*\(" + _CLASS + _CODE + r":\s*(.{0,200}?)(?:\s+at\s+\S+|\s+in\s+\S+|\\n|\z)"
)
EXCEPTION_BARE = (
    r"(?U)(?d)\.(?:ERROR|CRITICAL).*?" + _CLASS + _CODE + r"[:\s]+(.{0,160}?)(?:\s*\{|\z)"
)
# What differs between equal exceptions.
EXCEPTION_NOISE = (
    r"(?i)\b[0-9a-f]{6,}\b",
    r"\(\d+\)",
    r"\bat\s+\S+:\d+",
    r"\bin\s+\S+:\d+",
    r"(?i)line\s+\d+",
)
SEVERE_LINE = r"\.(?:ERROR|CRITICAL):"
# Marks of a level in a line.
LEVEL_HITS = {
    "errors": r"\.(?:ERROR|CRITICAL):",
    "warnings": r"\.WARNING:",
    "infos": r"\.INFO:",
}


def parse_records(lines: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Log lines to records; lines without a record header are dropped.

    An unreadable time is replaced by ``received_at`` (default: time of the batch). Key columns of
    the input (file, block, seq) are kept.

    Usually the first brace behind the header starts the blocks at the end of the line; then one
    pattern cuts all six fields in one pass. Where it does not match (braces in the message, nesting
    beyond its depth) the blocks are peeled off from the right, mark by mark. Each step is a
    projection of its own, so that nothing is worked out twice.
    """
    keys = [c for c in ("file", "block", "seq") if c in lines.columns]
    received = F.current_timestamp() if received_at is None else received_at
    odd, line, rest = F.col("_odd"), F.col("line"), F.col("_rest")

    def field(index: int) -> Column:
        return F.get("_parts", F.lit(index))

    head = F.regexp_extract(line, RECORD_HEADER, 0)
    name = F.translate(F.substring_index(head, "]", -1), BLANK_CHARS + ":", "")
    rows = (
        lines.where(line.rlike(RECORD_HEADER))
        .select(*keys, "line", F.split(F.regexp_replace("line", _WHOLE_LINE, _MARKED), _MARK).alias("_parts"))
        .withColumn("_odd", F.size("_parts") != 6)
        .select(
            *keys,
            "_odd",
            F.when(odd, F.substring_index(F.substring_index(head, "]", 1), "[", -1))
            .otherwise(field(0)).alias("_stamp"),
            F.when(odd, F.substring_index(name, ".", 1)).otherwise(field(1)).alias("channel"),
            F.upper(F.when(odd, F.substring_index(name, ".", -1)).otherwise(field(2))).alias("level_name"),
            F.rtrim(field(3)).alias("_text"),
            field(4).alias("_first"),
            field(5).alias("_second"),
            F.when(odd, _trimmed(F.substr(line, F.length(head) + 1))).alias("_rest"),
        )
    )
    steps = (
        # Rows whose blocks have to be peeled off; null for all others.
        ("_last", F.when(odd, _block_length(rest))),
        ("_before", _trimmed(F.substr(rest, F.lit(1), F.length(rest) - F.col("_last")))),
        ("_fore", F.when(odd, _block_length(F.col("_before")))),
    )
    for column, step in steps:
        rows = rows.withColumn(column, step)
    before, last, fore = F.col("_before"), F.col("_last"), F.col("_fore")
    text, first, second = F.col("_text"), F.col("_first"), F.col("_second")
    last_block = F.nullif(F.substr(rest, F.length(rest) - last + 1), F.lit(""))
    fore_block = F.substr(before, F.length(before) - fore + 1)
    # An empty list ahead of the only block, or up to two of them, stand for nothing.
    listed = text.endswith("[]") & (second == "")
    shorter = _without_list(text)
    message = (
        F.when(odd, _trimmed(F.substr(before, F.lit(1), F.length(before) - fore)))
        .when(~listed, text)
        .when((first == "") & shorter.endswith("[]"), _without_list(shorter))
        .otherwise(shorter)
    )
    context = F.when(odd, F.when(fore > 0, fore_block).otherwise(last_block)).when(~listed, first)
    extra = F.when(odd, F.when(fore > 0, last_block)).when(listed, first).otherwise(second)
    stamp = F.col("_stamp")
    # The header fixes the rest of the form; a zone must follow.
    zoned = stamp.endswith("Z") | (
        F.substr(stamp, F.lit(-6), F.lit(1)).isin("+", "-") & (F.substr(stamp, F.lit(-3), F.lit(1)) == ":")
    )
    return rows.select(
        *keys,
        F.coalesce(F.when(zoned, stamp.try_cast("timestamp")), received).alias("ts"),
        clip("channel", "channel").alias("channel"),
        level_code("level_name").alias("level"),
        clip("level_name", "level_name").alias("level_name"),
        clip(message, "message").alias("message"),
        context.alias("_context"),
        extra.alias("_extra"),
    ).select(
        *keys,
        "ts",
        "channel",
        "level",
        "level_name",
        "message",
        _filled("_context").alias("context"),
        _filled("_extra").alias("extra"),
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("ip"),
    )


BLANK_CHARS = " \t\n\f\r"

# A JSON object nested up to 16 levels. Every repetition is possessive: matching takes one pass and no
# recursion, however long the text is.
_JSON_STRING = r'"(?:[^"\\]++|\\.)*+"'
_JSON_OBJECT = r"\{(?:[^{}\"]++|" + _JSON_STRING + r")*+\}"
for _ in range(15):
    _JSON_OBJECT = r"\{(?:[^{}\"]++|" + _JSON_STRING + "|" + _JSON_OBJECT + r")*+\}"

# The fields of a whole line, and the mark put between them.
_WHOLE_LINE = (
    r"(?s)\A\s*+\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d++[^\]]*+)\]\s++(\w++)\.(\w++):\s++"
    rf"([^{{]*+)(?:({_JSON_OBJECT})\s*+({_JSON_OBJECT}|\[\])?+)?+\s*+\z"
)
_MARK = "\x01"
_MARKED = _MARK.join(f"${i}" for i in range(1, 7))
_BLANK_BLOCK = r"(?s)\A[\[{]\s*+[\]}]\z"
_JSON_TOKEN = r'(?s)\\.|["{}]|[^"{}\\]+|\\'


def _without_list(text: Column) -> Column:
    return F.rtrim(F.substr(text, F.lit(1), F.length(text) - 2))


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANK_CHARS))


def _block_length(text: Column) -> Column:
    """Length of the balanced block, or empty list, that ends the text; 0 if there is none."""
    marks = F.reverse(F.regexp_extract_all(text, F.lit(_JSON_TOKEN), F.lit(0)))

    def step(state: Column, mark: Column) -> Column:
        bare = ~state["quoted"]
        depth = (
            state["depth"]
            + F.when(bare & (mark == "}"), 1).otherwise(0)
            - F.when(bare & (mark == "{"), 1).otherwise(0)
        )
        moved = F.struct(
            depth.alias("depth"),
            F.when(mark == '"', bare).otherwise(state["quoted"]).alias("quoted"),
            (state["taken"] + F.length(mark)).alias("taken"),
            (bare & (mark == "{") & (depth == 0)).alias("closed"),
        )
        return F.when(state["closed"], state).otherwise(moved)

    start = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("taken"),
        F.lit(False).alias("closed"),
    )
    length = F.aggregate(
        marks, start, step, lambda state: F.when(state["closed"], state["taken"]).otherwise(0)
    )
    return F.when(text.endswith("}"), length).when(text.endswith("[]"), 2).otherwise(0)


def _filled(name: str) -> Column:
    """A block unless it is empty."""
    block = F.col(name)
    return F.when(~block.isin("", "{}", "[]") & ~block.rlike(_BLANK_BLOCK), block)


def resolve_origin(records: DataFrame) -> DataFrame:
    """url and ip of a record: from its context, else from extra, else as delivered."""
    out = records
    for name in ("url", "ip"):
        found = F.coalesce(
            F.get_json_object("context", f"$.{name}"),
            F.get_json_object("extra", f"$.{name}"),
            F.col(name),
        )
        out = out.withColumn(name, clip(found, name))
    return out


def carried_time(line: Column | str, iso: bool = True) -> Column:
    """Time at the start of a line, null if there is none.

    ``iso=False`` reads only the space-separated form closed right after the seconds.
    """
    pattern = CARRIED_TIME_ANY if iso else CARRIED_TIME
    return F.regexp_extract(as_col(line), pattern, 1).try_cast("timestamp")


def exception_of(line: Column | str) -> Column:
    """struct(class, message) of an exception line, null for other lines."""
    c = as_col(line)

    def found(pattern: str) -> Column:
        text = F.regexp_extract(c, pattern, 2)
        return F.when(
            c.rlike(pattern),
            F.struct(
                F.regexp_extract(c, pattern, 1).alias("class"),
                F.rtrim(trim_blanks(text), F.lit("\"'")).alias("message"),
            ),
        )

    # A plain substring test spares most lines the patterns.
    possible = c.contains("Exception") | c.contains("Error") | c.contains("Throwable")
    return F.when(possible, F.coalesce(found(EXCEPTION_OBJECT), found(EXCEPTION_BARE)))


def exception_key(exception: Column) -> Column:
    """Grouping key of an exception: class and message without ids, addresses and positions."""
    text = exception["message"]
    for pattern in EXCEPTION_NOISE:
        text = F.regexp_replace(text, pattern, "")
    return F.concat(
        exception["class"], F.lit(":"), trim_blanks(F.regexp_replace(text, r"\s+", " "))
    )


def loose_parts(line: Column | str) -> Column:
    """struct(stamp, text, channel, level) of any non-empty line; null where no text is left."""
    c = F.rtrim(as_col(line), F.lit(" \t\n\r\x00\x0b"))
    head = F.regexp_extract(c, LOOSE_STAMP, 0)
    text = F.when(head != "", F.substr(c, F.length(head) + 1)).otherwise(c)
    return F.when(
        text != "",
        F.struct(
            F.nullif(F.regexp_extract(c, LOOSE_STAMP, 1), F.lit("")).alias("stamp"),
            text.alias("text"),
            F.regexp_extract(text, LOOSE_CHANNEL, 1).alias("channel"),
            F.regexp_extract(text, LOOSE_CHANNEL, 2).alias("level"),
        ),
    )


def basic_regex(pattern: str) -> str:
    """A POSIX basic pattern (as grep takes it) in Java syntax.

    In the basic form ``+ ? | { } ( )`` are ordinary characters and gain their meaning behind a
    backslash; in Java it is the other way round.
    """
    out, i, start = [], 0, True
    while i < len(pattern):
        c = pattern[i]
        nxt = pattern[i + 1] if i + 1 < len(pattern) else ""
        if c == "\\" and nxt:
            if nxt in "+?|{}()":
                out.append(nxt)
                start = nxt in "(|"
            else:
                out.append(c + nxt)
                start = False
            i += 2
            continue
        if c == "[":
            end = pattern.find("]", i + (3 if nxt == "^" else 2))
            if end > 0:
                out.append(pattern[i : end + 1].replace("\\", "\\\\"))
                i, start = end + 1, False
                continue
            out.append("\\[")
        elif c in "+?|{}()" or (c == "*" and start):
            out.append("\\" + c)
        else:
            out.append(c)
        start = c == "^" and start
        i += 1
    return "".join(out)
