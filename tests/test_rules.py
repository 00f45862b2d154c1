import json
import random

import pytest
from pyspark.sql import functions as F

from callweave.functions import parse as P
from callweave.functions import registry as R
from callweave.functions import rules as U
from callweave.functions import values as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def state(**fields):
    return U.state_of({k: F.lit(v) for k, v in fields.items()})


@pytest.mark.parametrize(
    ("name", "args", "errors"),
    [
        ("set_climate", '{"temperature": 22}', []),
        ("set_climate", '{"temperature": 220}', ["set_climate.temperature: 220 > 30"]),
        ("set_climate", '{"temperature": 22.5, "power": "on"}', []),
        ("set_fan_speed", "{}", ["set_fan_speed: thiếu 'level'"]),
        ("set_fan_speed", '{"level": 0}', ["set_fan_speed.level: 0 < 1"]),
        ("set_lights", '{"mode": "blink"}', ["set_lights.mode: 'blink' không thuộc ['off', 'auto', 'low', 'high']"]),
        ("play_music", '{"query": " "}', ["play_music.query: chuỗi rỗng"]),
        ("set_volume", '{"level": true}', ["set_volume.level: cần kiểu integer, nhận bool"]),
        ("set_volume", '{"level": 5.0}', ["set_volume.level: cần kiểu integer, nhận float"]),
        ("set_volume", '{"unit": "x", "level": "5"}', ["set_volume: tham số lạ 'unit'", "set_volume.level: cần kiểu integer, nhận str"]),
        ("open_door", "{}", ["tool không tồn tại: open_door"]),
        ("lock_doors", "{}", []),
    ],
)
def test_validation(spark, name, args, errors):
    assert one(spark, U.validate_call(F.lit(name), V.arguments_of(F.lit(args)))) == errors


ORDER = {
    "type": "object",
    "required": ["id", "lines"],
    "properties": {
        "id": {"type": "string", "minLength": 1},
        "lines": {"type": "array", "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1, "maximum": 9}, "tags": {"type": "array", "items": {"type": "string", "enum": ["x", "y"]}}}}},
        "paid": {"type": "boolean"},
    },
}


@pytest.mark.parametrize(
    ("value", "errors"),
    [
        ('{"id":"a","lines":[{"n":1,"tags":["x","y"]},{"n":9}],"paid":true}', []),
        ('{"id":"a","lines":[]}', []),
        ('{"id":" ","lines":[{"n":0},{"n":10},{}]}', ["$.id: chuỗi rỗng", "$.lines[0].n: 0 < 1", "$.lines[1].n: 10 > 9", "$.lines[2]: thiếu 'n'"]),
        ('{"lines":[{"n":"1","tags":["z",3]}],"more":{}}', ["$: thiếu 'id'", "$.lines[0].n: cần kiểu integer, nhận str", "$.lines[0].tags[0]: 'z' không thuộc ['x', 'y']", "$.lines[0].tags[1]: cần kiểu string, nhận int", "$: tham số lạ 'more'"]),
        ('{"id":"a","lines":{"n":1},"paid":0}', ["$.lines: cần kiểu array, nhận dict", "$.paid: cần kiểu boolean, nhận int"]),
        ("[]", ["$: cần kiểu object, nhận list"]),
        ("null", ["$: cần kiểu object, nhận NoneType"]),
    ],
)
def test_nested_validation(spark, value, errors):
    assert one(spark, U.validate(F.parse_json(F.lit(value)), ORDER)) == errors


def test_numbers_are_spelled_as_by_printf(spark):
    rng = random.Random(1)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-5, 20) for _ in range(2000)] + [rng.randint(0, 10**7) / 10 ** rng.randint(0, 9) for _ in range(4000)]
    values += [k * 10.0**e for k in (1, 5, 9.999995, 9.9999949, 123456.5, 123455.5) for e in range(-4, 14)] + [0.0, 999999.5, 999999.4999, 1234565.0, 1234575.0, 9.999995e-5, float("nan"), float("inf"), float("-inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", V.spelled(F.col("v")).alias("s")).collect()
    assert [(r.v, r.s) for r in rows if r.s != f"{r.v:g}" and 1e-5 < abs(r.v) < 1e21] == []
    assert one(spark, V.spelled(F.lit(None).cast("double"))) is None


def test_a_zero_keeps_its_sign(spark):
    rows = spark.createDataFrame([(0.0,), (-0.0,)], "v double").select(V.spelled(F.col("v")).alias("s"), V.spelled(-F.col("v")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [("0", "-0"), ("-0", "0")]


def test_arguments_must_be_an_object(spark):
    assert one(spark, U.validate_variant(F.lit("lock_doors"), F.parse_json(F.lit("[1]")))) == ["lock_doors: cần kiểu object, nhận list"]
    assert one(spark, U.validate_variant(F.lit("set_volume"), F.parse_json(F.lit('{"level": 5}')))) == []


def test_duplicate_keys_keep_the_last(spark):
    assert one(spark, V.as_text(F.try_element_at(V.arguments_of(F.lit('{"a": 1, "a": 2}')), F.lit("a")))) == "2"


@pytest.mark.parametrize(
    ("name", "args", "fields", "decision"),
    [
        ("unlock_doors", "{}", {"speed_kmh": 0}, "allow"),
        ("unlock_doors", "{}", {"speed_kmh": 40}, "refuse"),
        ("set_lights", '{"mode": "off"}', {"speed_kmh": 40, "is_night": True}, "refuse"),
        ("set_lights", '{"mode": "off"}', {"speed_kmh": 40}, "allow"),
        ("set_lights", '{"mode": "low"}', {"speed_kmh": 40, "is_night": True}, "allow"),
        ("open_window", '{"position": "all"}', {"speed_kmh": 100}, "confirm"),
        ("open_window", '{"position": "all", "percent": 20}', {"speed_kmh": 100}, "allow"),
        ("open_window", '{"position": "all", "percent": "90"}', {"speed_kmh": 100}, "allow"),
        ("open_window", '{"position": "all"}', {"speed_kmh": 80}, "allow"),
    ],
)
def test_safety(spark, name, args, fields, decision):
    assert one(spark, U.check_call(F.lit(name), V.arguments_of(F.lit(args)), state(**fields)))["decision"] == decision


def test_worst_verdict(spark):
    calls = P.parse_output(F.lit('[{"name":"open_window","arguments":{"position":"all"}},{"name":"unlock_doors"}]'))["calls"]
    assert one(spark, U.check_calls(calls, state(speed_kmh=100)))["rule"] == "unlock_while_moving"


def test_states(spark):
    assert one(spark, U.render_state(U.state_from_json(F.lit('{"speed_kmh": 45.5, "range_km": 200, "cabin_temp_c": 22.0, "odd": 1}')))) == "tốc độ 45.5 km/h; số P; ban ngày; pin 80% (còn ~200 km); cửa đã khoá; trong xe 22°C"
    assert one(spark, U.state_from_json(F.lit(None).cast("string")))["doors_locked"] is True


@pytest.mark.parametrize(
    ("raw", "kind", "names", "valid"),
    [
        ('<tool_call>{"name":"set_fan_speed","arguments":{"level":3}}</tool_call>', "call", ["set_fan_speed"], True),
        ('<think>a</think><tool_call>{"name":"a"}</tool_call> <tool_call>{"function":{"name":"b","parameters":{}}}</tool_call><|im_end|>', "call", ["a", "b"], True),
        ('```json\n{"name":"lock_doors","arguments":{}}\n```', "call", ["lock_doors"], True),
        ('[{"name":"x","arguments":"{\\"k\\": 1}"},{"name":"y"}]', "call", ["x", "y"], True),
        ('<tool_call>{"name":"set_volume","arguments":{"level":5}}', "call", ["set_volume"], True),
        ('<tool_call>{"name":"set_volume","arguments":{"lev', "call", [], False),
        ('{"name":"a","arguments":{}}}', "call", ["a"], True),
        ('{"a":1}', "reply", [], False),
        ("Bạn muốn đi đâu?", "ask", [], True),
        ("", "reply", [], True),
        (None, "reply", [], True),
        ('<tool_call>{"name":5}</tool_call>', "call", [], False),
        ('<tool_call>{"name":"q","arguments":null}</tool_call>', "call", [], False),
    ],
)
def test_parsed_outputs(spark, raw, kind, names, valid):
    got = json.loads(one(spark, P.action_to_json(P.parse_output(F.lit(raw).cast("string")))))
    assert got["kind"] == kind and [c["name"] for c in got["calls"]] == names and got.get("valid_format", True) is valid


def test_argument_order_is_kept(spark):
    got = one(spark, F.map_keys(F.element_at(P.parse_output(F.lit('{"name":"a","arguments":{"z":1,"b":2,"a":3}}'))["calls"], 1)["arguments"]))
    assert got == ["z", "b", "a"]


def test_server_messages(spark):
    good = F.array(F.lit('{"id":"1","type":"function","function":{"name":"lock_doors","arguments":"{}"}}'), F.lit('{"function":{"name":""}}'))
    got = one(spark, P.from_openai_message(F.lit(None).cast("string"), good)["valid_format"])
    assert got is False
    assert one(spark, P.from_openai_message(F.lit("Chào bạn."), F.array().cast("array<string>"))["kind"]) == "reply"


def test_actions_round_trip(spark):
    act = P.action_from_json(F.lit('{"kind":"call","calls":[{"name":"a","arguments":null},{"name":"b","arguments":{"x":true}}]}'))
    assert json.loads(one(spark, P.action_to_json(act))) == {"kind": "call", "calls": [{"name": "a", "arguments": {}}, {"name": "b", "arguments": {"x": True}}], "text": ""}


def guard(spark, raw, confirmed=False, **fields):
    return json.loads(one(spark, P.action_to_json(U.guard_action(P.parse_output(F.lit(raw)), state(**fields), F.lit(confirmed)))))


def test_guard(spark):
    window = '{"name":"open_window","arguments":{"position":"all"}}'
    assert guard(spark, '{"name":"unlock_doors"}', speed_kmh=50)["kind"] == "refuse"
    assert guard(spark, window, speed_kmh=100)["kind"] == "ask"
    assert guard(spark, window, confirmed=True, speed_kmh=100)["kind"] == "call"
    lost = guard(spark, '{"name":"open_door"}', speed_kmh=0)
    assert lost["kind"] == "ask" and lost["text"] == U.UNCLEAR
    half = guard(spark, f'[{window},{{"name":"open_door"}}]', speed_kmh=0)
    assert [c["name"] for c in half["calls"]] == ["open_window"] and len(half["notes"]) == 2
    assert guard(spark, "Chào bạn.", speed_kmh=100) == {"kind": "reply", "calls": [], "text": "Chào bạn."}


@pytest.mark.parametrize(
    ("gold", "pred", "same"),
    [
        ('[{"name":"lock_doors"},{"name":"set_climate","arguments":{"power":"on"}}]', '[{"name":"set_climate"},{"name":"lock_doors"}]', True),
        ('{"name":"navigate_to","arguments":{"destination":"Bến Nhà Rồng"}}', '{"name":"navigate_to","arguments":{"destination":"toi ben nha rong"}}', True),
        ('{"name":"navigate_to","arguments":{"destination":"ga tàu Sài Gòn"}}', '{"name":"navigate_to","arguments":{"destination":"Sài Gòn"}}', True),
        ('{"name":"navigate_to","arguments":{"destination":"núi Bà Đen"}}', '{"name":"navigate_to","arguments":{"destination":"núi Cấm"}}', False),
        ('{"name":"lookup_sign","arguments":{"code":"W.219"}}', '{"name":"lookup_sign","arguments":{"code":"w 219"}}', True),
        ('{"name":"set_volume","arguments":{"level":5}}', '{"name":"set_volume","arguments":{"level":" 5 "}}', True),
        ('{"name":"call_contact","arguments":{"name":"5"}}', '{"name":"call_contact","arguments":{"name":5}}', False),
        ('{"name":"navigate_to","arguments":{"destination":"nhà"}}', '{"name":"navigate_to","arguments":{"destination":"nhà","avoid_tolls":false}}', False),
        ('{"name":"set_reminder","arguments":{"text":"mua sữa cho con","minutes":30}}', '{"name":"set_reminder","arguments":{"text":"mua sữa","minutes":30.0}}', True),
        ('{"name":"open_window","arguments":{"position":"all","percent":100.0}}', '{"name":"open_window","arguments":{"position":"all"}}', True),
        ('[{"name":"lock_doors"},{"name":"lock_doors"}]', '{"name":"lock_doors"}', False),
    ],
)
def test_matching(spark, gold, pred, same):
    assert one(spark, V.actions_match(P.parse_output(F.lit(gold)), P.parse_output(F.lit(pred)))) is same


def test_registry_declarations():
    tools = R.openai_tools(["set_volume", "lock_doors"])
    assert [t["function"]["name"] for t in tools] == ["set_volume", "lock_doors"]
    assert tools[0]["function"]["parameters"] == {"type": "object", "properties": {"level": {"type": "integer", "minimum": 0, "maximum": 30}}, "required": ["level"]}
    assert len(R.TOOLS) == 17


def test_the_parser_names_its_texts_once(spark):
    """What an expression repeats is computed again in each row."""
    assert str(P.load_json(F.col("s"))).count("regexp_replace") <= 4
