"""Masking of sensitive values in JSON text, as built-in functions.

Flat objects, and texts nested up to SHALLOW levels, are checked and masked by patterns. Others are cut into tokens, which
one fold reads from left to right: it checks the grammar and notes where the values of sensitive names
lie, at any depth; what lies between them is kept byte for byte. Open brackets are bits: LEVELS of them
in a number, those below in an array of numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession, functions as F

# A parameter whose name contains one of these is masked.
SENSITIVE_FRAGMENTS = (
    "password",
    "passwd",
    "secret",
    "token",
    "auth",
    "apikey",
    "api_key",
    "credential",
    "private_key",
    "access_key",
)
MASK = "***"

SHALLOW, LEVELS = 4, 60

# A string as JSON has it; a token is a string, a mark, white space or what lies between these.
STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
TOKEN = rf"(?s){STRING}|[{{}}\[\]:,]|[ \t\n\r]++|[^{{}}\[\]:,\" \t\n\r]++|."
PLAIN = r"\A(?:true|false|null|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)\z"


def _words(spelt) -> str:
    """Any of the fragments, each letter as ``spelt`` gives it; a first letter is looked at once."""
    by_letter: dict[str, list[str]] = {}
    for fragment in SENSITIVE_FRAGMENTS:
        by_letter.setdefault(fragment[0], []).append("".join(map(spelt, fragment[1:])))
    return "|".join(f"{spelt(first)}(?:{'|'.join(rest)})" for first, rest in by_letter.items())


def _escaped(letter: str) -> str:
    """A letter as such or as an escape, in either case."""
    codes = "|".join(sorted({f"{ord(c):04x}" for c in (letter.lower(), letter.upper())}))
    return rf"(?:{letter}|\\u(?:{codes}))"


_FIRST = "".join(sorted({fragment[0] for fragment in SENSITIVE_FRAGMENTS}))
_FIRST += _FIRST.upper()
_WORD = rf"(?=[{_FIRST}])(?:{_words(str)})"
FRAGMENT = f"(?i){_words(_escaped)}"
# A word as such, or an escape that may spell one.
SUSPECT = rf"(?i){_WORD}|\\u00"

# One object of plain names and values without a backslash in it, and a pair to mask.
_FLAT_VALUE = r'(?:"[^"\\\x00-\x1f]*+"|true|false|null|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+)'
FLAT_OBJECT = (
    r'\A\{[ \t\n\r]*+(?:"[^"\\\x00-\x1f]*+"[ \t\n\r]*+:[ \t\n\r]*+'
    rf'{_FLAT_VALUE}[ \t\n\r]*+(?:,[ \t\n\r]*+(?=")|(?=\}})))*+\}}\z'
)
FLAT_SECRET = (
    rf'(?i)("[^"]*(?:{"|".join(SENSITIVE_FRAGMENTS)})[^"]*"[ \t\n\r]*+:[ \t\n\r]*+)(?:"[^"]*+"|[^",{{}} \t\n\r]++)'
)

_SPACE = r"[ \t\n\r]*+"
_SCALAR = r"(?:true|false|null|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+)"
_VALUE = rf"(?:{STRING}|{_SCALAR})"
for _ in range(SHALLOW):
    _VALUE = (
        rf"(?:{STRING}|{_SCALAR}"
        rf"|\{{{_SPACE}(?:{STRING}{_SPACE}:{_SPACE}{_VALUE}{_SPACE}(?:,{_SPACE}(?=\")|(?=\}})))*+\}}"
        rf"|\[{_SPACE}(?:{_VALUE}{_SPACE}(?:,{_SPACE}(?=[^\] ])|(?=\])))*+\])"
    )
SHALLOW_JSON = rf"\A{_SPACE}{_VALUE}{_SPACE}\z"

# In a text that is known to be JSON a string before a colon is a name, and a value ends where its
# brackets do. Names that may be spelt with escapes are left to the fold. Each match takes all up to the next sensitive name along.
_ANY_STRING = r'"(?:[^"\\]++|\\.)*+"'
_BLOCK = rf'[\[{{](?:[^\[\]{{}}"]++|{_ANY_STRING})*+[\]}}]'
for _ in range(SHALLOW - 1):
    _BLOCK = rf'[\[{{](?:[^\[\]{{}}"]++|{_ANY_STRING}|{_BLOCK})*+[\]}}]'
_SECRET = (
    rf'"(?:[^"\\{_FIRST}]++|(?!{_WORD})[^"\\]|\\.)*+(?={_WORD})(?:[^"\\]++|\\.)*+"{_SPACE}:{_SPACE}'
)
SHALLOW_SECRET = (
    rf'(?is)\G((?:[^"]++|(?!{_SECRET}){_ANY_STRING})*+{_SECRET})(?:{_ANY_STRING}|{_BLOCK}|[^,\[\]{{}}" \t\n\r]++)'
)

# Kinds of tokens, and what the fold expects next.
OPEN_OBJECT, OPEN_LIST, CLOSE_OBJECT, CLOSE_LIST, COLON, COMMA, TEXT, SCALAR, BLANK, BAD = range(10)
VALUE, FIRST_VALUE, FIRST_NAME, NAME, NAMED, AFTER, WRONG = range(7)

_CUTS = "array<struct<low:int,high:int>>"


def _kind(token: Column) -> Column:
    marks = F.instr(F.lit("{[}]:,"), token)
    return (
        F.when((F.length(token) == 1) & (marks > 0), marks - 1)
        .when(token.rlike(r'\A"(?s:.+)"\z'), F.lit(TEXT))
        .when(token.rlike(r"\A[ \t\n\r]"), F.lit(BLANK))
        .when(token.rlike(PLAIN), F.lit(SCALAR))
        .otherwise(F.lit(BAD))
    )


def _step(state: Column, token: Column) -> Column:
    kind, expects, depth = token["kind"], state["expects"], state["depth"]
    in_object = state["top"].bitwiseAND(F.lit(1).cast("bigint")) == 1
    begins = expects.isin(VALUE, FIRST_VALUE) & kind.isin(OPEN_OBJECT, OPEN_LIST, TEXT, SCALAR)
    opens = begins & kind.isin(OPEN_OBJECT, OPEN_LIST)
    done = (expects == AFTER) & (depth > 0)
    closes = ((kind == CLOSE_LIST) & ((expects == FIRST_VALUE) | (done & ~in_object))) | (
        (kind == CLOSE_OBJECT) & ((expects == FIRST_NAME) | (done & in_object))
    )
    names = (kind == TEXT) & expects.isin(FIRST_NAME, NAME)
    following = (
        F.when(kind == BLANK, expects)
        .when(opens, F.when(kind == OPEN_OBJECT, F.lit(FIRST_NAME)).otherwise(F.lit(FIRST_VALUE)))
        .when(begins | closes, F.lit(AFTER))
        .when(names, F.lit(NAMED))
        .when((expects == NAMED) & (kind == COLON), F.lit(VALUE))
        .when(done & (kind == COMMA), F.when(in_object, F.lit(NAME)).otherwise(F.lit(VALUE)))
        .otherwise(F.lit(WRONG))
    )
    bit = F.when(kind == OPEN_OBJECT, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    full = state["top"] >= 1 << LEVELS
    below = F.shiftright(state["top"], 1)
    spent = (below == 1) & (F.size(state["rest"]) > 0)
    top = (
        F.when(opens, F.when(full, F.lit(2).cast("bigint")).otherwise(state["top"] * 2) + bit)
        .when(closes, F.when(spent, F.element_at(state["rest"], -1)).otherwise(below))
        .otherwise(state["top"])
    )
    rest = (
        F.when(opens & full, F.array_append(state["rest"], state["top"]))
        .when(closes & spent, F.slice(state["rest"], F.lit(1), F.size(state["rest"]) - 1))
        .otherwise(state["rest"])
    )
    end = state["at"] + token["size"]
    # ``hidden`` is the depth a masked value stands at, -1 outside of one.
    starts = begins & state["hot"] & (state["hidden"] < 0)
    begin = F.when(starts, state["at"]).otherwise(state["low"])
    ends = (starts & ~opens) | (closes & (depth - 1 == state["hidden"]))
    cut = F.struct(begin.alias("low"), end.alias("high"))
    return F.when(expects == WRONG, state).otherwise(
        F.struct(
            following.alias("expects"),
            F.when(opens, depth + 1).when(closes, depth - 1).otherwise(depth).alias("depth"),
            top.alias("top"),
            rest.alias("rest"),
            F.when(names, token["sensitive"]).when(begins, F.lit(False)).otherwise(state["hot"]).alias("hot"),
            F.when(starts & opens, depth).when(ends, F.lit(-1)).otherwise(state["hidden"]).alias("hidden"),
            begin.alias("low"),
            F.when(ends, F.array_append(state["cuts"], cut)).otherwise(state["cuts"]).alias("cuts"),
            end.alias("at"),
        )
    )


def mask_json(text: Column) -> Column:
    """The text with the value of every sensitive name replaced, whatever it is; nothing else changes.

    A text without a sensitive word passes as it is. One that has such a word and is no JSON could hide
    a secret from the reading: it is masked whole. Null stays null.
    """
    masked = rf'$1"{MASK}"'
    return (
        F.when(~text.rlike(SUSPECT), text)
        .when(text.rlike(FLAT_OBJECT), F.regexp_replace(text, FLAT_SECRET, masked))
        .when(
            ~text.contains("\\u00") & text.rlike(SHALLOW_JSON),
            F.regexp_replace(text, SHALLOW_SECRET, masked),
        )
        .when(text.rlike(FRAGMENT), fold_json(text))
        .otherwise(text)
    )


def fold_json(text: Column) -> Column:
    """``mask_json`` for any JSON, token by token; a text that is no JSON is masked whole."""
    tokens = F.transform(
        F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)),
        lambda t: F.struct(
            _kind(t).alias("kind"), F.length(t).alias("size"), t.rlike(FRAGMENT).alias("sensitive")
        ),
    )
    start = F.struct(
        F.lit(VALUE).alias("expects"),
        F.lit(0).alias("depth"),
        F.lit(1).cast("bigint").alias("top"),
        F.array().cast("array<bigint>").alias("rest"),
        F.lit(False).alias("hot"),
        F.lit(-1).alias("hidden"),
        F.lit(0).alias("low"),
        F.array().cast(_CUTS).alias("cuts"),
        F.lit(1).alias("at"),
    )

    def result(state: Column) -> Column:
        # The kept pieces lie between the end of a cut and the beginning of the next.
        first = F.concat(F.array(F.lit(1)), F.transform(state["cuts"], lambda c: c["high"]))
        last = F.concat(F.transform(state["cuts"], lambda c: c["low"]), F.array(state["at"]))
        kept = F.zip_with(first, last, lambda a, b: F.substr(text, a, b - a))
        whole = (state["expects"] == AFTER) & (state["depth"] == 0)
        return F.when(whole, F.array_join(kept, f'"{MASK}"')).otherwise(f'"{MASK}"')

    return F.when(text.isNotNull(), F.aggregate(tokens, start, _step, result))


# A quoted text, which stays as it is, or an operator written as a function, which needs quotes.
_OPERATOR = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])(and|or|not|in|[=<>!+*/&-]+)\(", re.S)


def sql_text(column: Column) -> str:
    """A column of built-in functions as SQL."""
    text = column._jc.node().sql()
    return _OPERATOR.sub(lambda m: f"`{m[1]}`(" if m[1] else m[0], text)


def register_functions(spark: SparkSession) -> None:
    """Make masking callable from SQL, as a SQL function of the same expression."""
    body = sql_text(mask_json(F.col("t")))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION mask_json(t STRING) RETURNS STRING RETURN {body}")
