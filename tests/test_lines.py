"""Parsing and text expressions on hand-written lines."""

import re

import pytest
from pyspark.sql import functions as F

from opslens.functions.masking import register_functions
from opslens.functions.levels import level_code
from opslens.functions.loglines import (
    basic_regex,
    exception_key,
    exception_of,
    loose_parts,
    parse_records,
)
from opslens.functions.text import (
    instance_id,
    kb_map,
    mask_params,
    message_key,
    number_text,
    params_fingerprint,
    path_template,
    queue_topic,
    sql_template,
)
from opslens.operators.search import at_least, level_lines
from opslens.schemas import LOG_LINE

HEAD = "[2031-02-14T18:07:45.360912+00:00] "


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expr.alias("x")).first()["x"]


def parse(spark, *lines):
    rows = [("a.log", 0, i, line) for i, line in enumerate(lines)]
    return parse_records(spark.createDataFrame(rows, LOG_LINE), F.lit("2000-01-01").cast("timestamp"))


def test_two_json_tails(spark):
    row = parse(spark, HEAD + 'orders.WARNING: stock is low {"sku":"a"} {"host":"b"}').first()
    assert (row.channel, row.level, row.level_name) == ("orders", 300, "WARNING")
    assert (row.message, row.context, row.extra) == ("stock is low", '{"sku":"a"}', '{"host":"b"}')
    assert row.ts.microsecond == 360912


@pytest.mark.parametrize(
    "rest, message, context, extra",
    [
        ("text [] []", "text", None, None),
        ("text", "text", None, None),
        ('text {"e":"x"} {}', "text", '{"e":"x"}', None),
        ('text {"e":"x"} []', "text", '{"e":"x"}', None),
        ('text [] {"e":"x"}', "text", None, '{"e":"x"}'),
        ('text {"e":"x"}', "text", '{"e":"x"}', None),
        ('box {"shelf":{"rows":[[3],{"n":4}]}} {}', "box", '{"shelf":{"rows":[[3],{"n":4}]}}', None),
        ('box {"lid":"} {"} {"side":{}}', "box", '{"lid":"} {"}', '{"side":{}}'),
        ('box {"lid":"up \\" } down"} []', "box", '{"lid":"up \\" } down"}', None),
        ('user {id} gone {"id":7} []', "user {id} gone", '{"id":7}', None),
        ("a } b", "a } b", None, None),
        ("tail is open {", "tail is open {", None, None),
        ('  x  {"a":1}   {"b":2}  ', "x", '{"a":1}', '{"b":2}'),
    ],
)
def test_message_tails(spark, rest, message, context, extra):
    row = parse(spark, HEAD + "app.ERROR: " + rest).first()
    assert (row.message, row.context, row.extra) == (message, context, extra)


@pytest.mark.parametrize(
    "line",
    ["", "   ", "free text", "[2031-02-14T18:07:45.2", "[2031-02-14T18:07:45+00:00] a.INFO: no fraction"],
)
def test_lines_without_header_are_dropped(spark, line):
    assert parse(spark, line).count() == 0


def test_level_is_upper_cased_and_bad_time_replaced(spark):
    rows = parse(
        spark,
        "  [2031-13-45T18:07:45.2+00:00] app.error: x  ",
        "[2031-02-14T18:07:45.2 somewhere] app.Odd: x",
        "[2031-02-14T18:07:45.25+02:00] app.ALERT: x\r",
    ).orderBy("seq").collect()
    assert [r.level_name for r in rows] == ["ERROR", "ODD", "ALERT"]
    assert [r.level for r in rows] == [400, 0, 550]
    assert [str(r.ts) for r in rows][:2] == ["2000-01-01 00:00:00"] * 2
    assert str(rows[2].ts) == "2031-02-14 16:07:45.250000"


@pytest.mark.parametrize(
    "level, least, kept",
    [("ERROR", "WARNING", True), ("WARNING", "WARNING", True), ("NOTICE", "WARNING", False),
     ("EMERGENCY", "ALERT", True), ("DEBUG", "INFO", False), ("ODD", "DEBUG", False), ("ODD", "ODD", True)],
)
def test_level_order(spark, level, least, kept):
    df = spark.range(1).select(level_code(F.lit(level)).alias("level"))
    assert (at_least(df, least).count() == 1) is kept


@pytest.mark.parametrize(
    "sql, template",
    [
        ("SELECT * FROM t WHERE id = 5", "SELECT * FROM t WHERE id = ?"),
        ("SELECT 1 -- x\nFROM t", "SELECT ? FROM t"),
        ("SELECT a /* b\nc */ FROM t2", "SELECT a FROM t2"),
        ("SELECT a FROM t WHERE n = 'it\\'s' AND b='x'", "SELECT a FROM t WHERE n = ? AND b=?"),
        ("x in ( 1 , 2,3 )", "x IN (?)"),
        ("x IN (?, ?, ?, ?)", "x IN (?)"),
        ("  a\t b\n", "a b"),
        ("v = 1.50 or v2 = 3", "v = ? or v2 = ?"),
        ("'" + "a" * 20_000 + "' b", "? b"),
        ("a" * 1_500, "a" * 1_500),
    ],
)
def test_sql_template(spark, sql, template):
    assert one(spark, sql_template("s"), s=sql) == template


@pytest.mark.parametrize(
    "path, template",
    [
        ("/admin/user/123/edit", "/admin/user/{id}/edit"),
        ("/api/v1/orders/9999", "/api/v1/orders/{id}"),
        ("/a/1/2/3", "/a/{id}/{id}/{id}"),
        ("/plain", "/plain"),
        ("/x/7?page=2&id=8", "/x/{id}"),
        ("/", "/"),
        ("/sku/a12/b", "/sku/a12/b"),
        ("/" + "x" * 600, "/" + "x" * 499),
    ],
)
def test_path_template(spark, path, template):
    assert one(spark, path_template("p"), p=path) == template


@pytest.mark.parametrize(
    "params, masked",
    [
        ('{"password":"x"}', '{"password":"***"}'),
        ('{"user_PASSWD":5,"a":1}', '{"user_PASSWD":"***","a":1}'),
        ('{"my_secret":null,"Token":true}', '{"my_secret":"***","Token":"***"}'),
        ('{"authority":"x","ApiKey":"q\\"r"}', '{"authority":"***","ApiKey":"***"}'),
        ('{"credentials":{"a":1},"b":[1]}', '{"credentials":"***","b":[1]}'),
        ('{"a":{"private_key":"k","c":2}}', '{"a":{"private_key":"***","c":2}}'),
        ('["password","x"]', '["password","x"]'),
        ('{"name":"token"}', '{"name":"token"}'),
        ('{"note":"a \\"token\\":1 b"}', '{"note":"a \\"token\\":1 b"}'),
        ("{}", "{}"),
        (None, None),
    ],
)
def test_masking(spark, params, masked):
    df = spark.createDataFrame([(params,)], "p string").select(mask_params("p").alias("x"))
    assert df.first()["x"] == masked


@pytest.mark.parametrize(
    "line, cls, message",
    [
        ('x {"e":"[object] (App\\\\Bad\\\\SaveException(code: 0): no row at /srv/a.php:12)', "App\\\\Bad\\\\SaveException", "no row"),
        ("[object] (TypeError: wrong in /srv/b.php:3)", "TypeError", "wrong"),
        ("[object] (OopsThrowable: 'quoted'", "OopsThrowable", "'quoted"),
        ("a.ERROR: failed: App\\FooException: it broke {\"a\":1}", "App\\FooException", "it broke"),
        ("a.CRITICAL: \\FooException: it broke", "FooException", "it broke"),
        ("a.INFO: App\\FooException: it broke", None, None),
        ("plain", None, None),
        ("[object] (Exception: bare)", None, None),
        ("[object] (LongError: " + "x" * 201, None, None),
        ("[object] (LongError: " + "x" * 200, "LongError", "x" * 200),
    ],
)
def test_exception_of(spark, line, cls, message):
    found = one(spark, exception_of("line"), line=line)
    assert (found and found["class"], found and found["message"]) == (cls, message)


@pytest.mark.parametrize(
    "message, rest",
    [("id deadbeef01 lost", "id lost"), ("row (12) gone", "row gone"), ("bad line 42 here", "bad here"),
     ("fails at foo:12 now", "fails now"), ("fails in foo:9", "fails"), ("cafe stays", "cafe stays")],
)
def test_exception_key(spark, message, rest):
    e = F.struct(F.lit("E").alias("class"), F.col("m").alias("message"))
    assert one(spark, exception_key(e), m=message) == f"E:{rest}"


def test_loose_parts(spark):
    p = one(spark, loose_parts("line"), line="[2026-05-22T15:31:01+00:00] my-app.INFO: hi  there \t")
    assert (p.stamp, p.text, p.channel, p.level) == ("2026-05-22T15:31:01+00:00", "my-app.INFO: hi  there", "my-app", "INFO")
    assert one(spark, loose_parts("line"), line="[2026-05-22 15:31:01]  ") is None
    assert one(spark, loose_parts("line"), line="   ") is None


@pytest.mark.parametrize(
    "basic, text, hit",
    [("a+b", "a+b", True), ("a+b", "aab", False), (r"a\+b", "aab", True), ("x{2}", "x{2}", True),
     (r"x\{2\}", "xx", True), ("(a|b)", "(a|b)", True), (r"\(a\|b\)c", "bc", True), ("*a", "*a", True),
     ("a.c", "abc", True), ("^a$", "a", True), ("[.]x", ".x", True), ("[]x]y", "]y", True),
     (r"a\.b", "a.b", True), (r"a\.b", "axb", False), ("a?", "a?", True), ("[", "[", True)],
)
def test_basic_regex(spark, basic, text, hit):
    assert one(spark, F.col("t").rlike(basic_regex(basic)), t=text) is hit


def test_level_lines(spark):
    df = spark.createDataFrame([("a.ERROR: x",), ("aXERROR: x",)], "line string")
    assert df.where(level_lines("error")).count() == 1
    assert df.where(level_lines("error", exact=False)).count() == 2


def test_message_key(spark):
    def key(channel, level, message):
        return one(spark, message_key("c", "l", "m", 30), c=channel, l=level, m=message)

    base = key("app", 300, "x" * 30 + "one")
    assert base == key("app", 300, "x" * 30 + "two")
    assert base != key("app", 400, "x" * 30) and base != key("web", 300, "x" * 30)
    assert re.fullmatch("[0-9a-f]{32}", key("app", 300, "s"))


def test_queue_topic(spark):
    def topic(body, **props):
        pairs = [F.lit(x) for kv in props.items() for x in kv]
        m = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        return one(spark, queue_topic(m, F.lit(body).cast("string")), z=1)

    assert topic("b", topic_name="a.b") == "mq://a.b"
    assert topic("b", topic_name="0", topic="t") == "mq://t"
    assert topic("b").startswith("mq://body:92eb5ffee6ae2fec3ad71c777531578f")
    assert topic(None, topic="t") == "mq://unknown"


def test_small_texts(spark):
    assert one(spark, number_text(F.lit(50.0)), z=1) == "50"
    assert one(spark, number_text(F.lit(50.25)), z=1) == "50.25"
    assert len(one(spark, instance_id("h", "i"), h="web", i="10.0.0.1")) == 12


MASK_CASES = [
    ('{"App\\\\Token":"s1"}', '{"App\\\\Token":"***"}'),
    ('{"to\\u006ben":"s2"}', '{"to\\u006ben":"***"}'),
    ('{"x":[{"Api_Key":["s3","s4"]},{"y":1}]}', '{"x":[{"Api_Key":"***"},{"y":1}]}'),
    ('{"PASSWORD":"s5","a":"b"}', '{"PASSWORD":"***","a":"b"}'),
    ('{"a":"token","b":"secret"}', '{"a":"token","b":"secret"}'),
    ('{"q":"say \\"token\\": \\"s\\"","auth":"s6"}', '{"q":"say \\"token\\": \\"s\\"","auth":"***"}'),
    ('{"token":"s7"', '"***"'),
    ('{"token":s8}', '"***"'),
    ("token=s9", '"***"'),
    ('{"secret":1.5e3,"n":null}', '{"secret":"***","n":null}'),
]


@pytest.mark.parametrize(("params", "masked"), MASK_CASES)
def test_no_secret_passes(spark, params, masked):
    """Whichever way a text takes, flat or nested: the same rule for names."""
    assert one(spark, mask_params("p"), p=params) == masked
    nested = '{"deep":' + params + "}"
    wanted = '"***"' if masked == '"***"' else '{"deep":' + masked + "}"
    assert one(spark, mask_params("p"), p=nested) == wanted


def test_fingerprints_ignore_blanks_between_values(spark):
    prints = [one(spark, params_fingerprint("p"), p=p) for p in (
        '{"a":1,"b":"x y"}', '{ "a": 1,\n"b": "x y" }', '{"a":1,"b":"xy"}', '{"b":"x y","a":1}',
    )]
    assert prints[0] == prints[1] and len(set(prints)) == 3


def test_of_repeated_memory_keys_the_last_counts(spark):
    text = "MemTotal:  10 kB\nMemFree:  4 kB\nMemTotal:  12 kB\nother"
    assert one(spark, kb_map("t"), t=text) == {"MemFree": 4, "MemTotal": 12}
    assert one(spark, kb_map("t"), t="nothing") == {}


@pytest.mark.parametrize("depth", [15, 16, 17, 40])
def test_nesting_around_the_limit_of_the_pattern(spark, depth):
    block = '{"k\\"}":' * depth + '"} {\\"' + '"' + "}" * depth
    row = parse(spark, HEAD + "app.ERROR: text " + block + " {}").first()
    assert (row.message, row.context, row.extra) == ("text", block, None)


def test_long_blocks_are_matched_without_recursion(spark):
    quoted = '{"a":"' + '\\"x' * 50_000 + '"}'
    many = "{" + ",".join(f'"k{i}":"v{{{i}"' for i in range(20_000)) + "}"
    deep = '{"a":' * 60 + "1" + "}" * 60
    for block in (quoted, many, deep):
        row = parse(spark, HEAD + "app.ERROR: text " + block + " {}").first()
        assert (row.message, row.context, row.extra) == ("text", block, None)


def test_marks_inside_a_line(spark):
    row = parse(spark, HEAD + 'app.ERROR: a\x01b {"k":1} {"l":2}').first()
    assert (row.message, row.context, row.extra) == ("a\x01b", '{"k":1}', '{"l":2}')


def test_functions_are_callable_from_sql(spark):
    register_functions(spark)
    row = spark.sql("""SELECT mask_json('{"x":{"token":1}}') m""").first()
    assert row.m == '{"x":{"token":"***"}}'
