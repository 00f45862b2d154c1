"""More registered queries: over records, predictions, messages, seeds and sinks that are derived from the driver's tables.

Each takes its input from a table by expressions that the SQL beside it has as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import rules as U
from ..functions import text as T
from ..functions import values as V
from ..functions.parse import action_from_json, action_to_json, from_openai_message
from ..operators import chat, dataset, metrics, pairs, seeds
from ..operators.predict import Scripted, decide, predict
from ..operators.storage import scratch, stored
from ..sources import files
from ..streaming.guard import append_once, guarded
from .catalog import (
    _SQL_JUDGED,
    _SQL_MEASURED,
    _SQL_SEEDS,
    _SQL_SPLIT,
    SQL_EVENTS,
    SQL_FOLD,
    _answers,
    _calls,
    _events,
    _predictions,
    _query,
    _quoted,
    _sql_chance,
    _sql_grams,
    _sql_norm,
    _sql_pick,
    _sql_words,
    _table,
)

HISTORY = "array<struct<role: string, content: string>>"


def _case(k: Column, *options: Column | str) -> Column:
    """The option at k, from 0; the last where k is beyond."""
    own = [F.lit(o) if isinstance(o, str) else o for o in options]
    out = F.when(k == 0, own[0])
    for i, o in enumerate(own[1:-1], 1):
        out = out.when(k == i, o)
    return out.otherwise(own[-1])


def _say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# Comparing -----------------------------------------------------------------------------------------------------------

# seven words as they stand, and an answer: all with signs, the first four, the first two, the fourth to tenth, a number
_SQL_SAID = """
WITH x AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS k, string_split(text, ' ') AS w FROM conversations),
y AS (SELECT conv_id, turn, k, array_to_string(w[1:7], ' ') AS gold, CASE k WHEN 0 THEN array_to_string(w[1:7], ', ') || '!' WHEN 1 THEN array_to_string(w[1:4], ' ') WHEN 2 THEN array_to_string(w[1:2], ' ') ELSE array_to_string(w[4:10], ' ') END AS pred FROM x)
"""


@_query(_SQL_SAID + f""", z AS (SELECT *, {_sql_words('gold')} AS g, {_sql_words('pred')} AS p, list_distinct({_sql_words('gold')}) AS dg, list_distinct({_sql_words('pred')}) AS dp,
  regexp_replace({SQL_FOLD.format(x='gold')}, '[^a-z0-9]', '', 'g') AS ag, regexp_replace({SQL_FOLD.format(x='pred')}, '[^a-z0-9]', '', 'g') AS ap FROM y),
s AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda v: least(len(list_filter(p, lambda u: u = v)), len(list_filter(g, lambda u: u = v))))), 0) AS shared FROM z)
SELECT conv_id, turn, k < 4 AND CASE WHEN len(p) = 0 OR len(g) = 0 THEN len(p) = len(g) ELSE 2.0::DOUBLE * shared / (len(p) + len(g)) >= 0.5 END AS free,
  k < 4 AND len(dg) > 0 AND len(dp) > 0 AND (len(list_intersect(dg, dp)) = len(dg) OR (len(list_intersect(dg, dp)) = len(dp) AND 2 * len(dp) >= len(dg))) AS named,
  k < 4 AND ({_sql_norm('gold')} = {_sql_norm('pred')} OR (ag <> '' AND ag = ap)) AS same FROM s
""")
def text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values compared as free text, as names and as strings."""
    w = F.split("text", " ", -1)
    cut = lambda a, n, by=" ": F.array_join(F.slice(w, a, n), by)
    k = (F.col("conv_id") + F.col("turn")) % 5
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", k.alias("k"), cut(1, 7).alias("gold"), _case(k, _say(cut(1, 7, ", "), "!"), cut(1, 4), cut(1, 2), cut(4, 7)).alias("pred"))
    g, p = F.col("gold").cast("variant"), F.when(F.col("k") < 4, F.col("pred").cast("variant")).otherwise(F.parse_json(F.lit("5")))
    same = lambda tool, key: V.arg_equal(F.lit(tool), F.lit(key), g, p)
    return rows.select("conv_id", "turn", same("set_reminder", "text").alias("free"), same("navigate_to", "destination").alias("named"), same("call_contact", "name").alias("same"))


@_query(f"""
WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations),
g AS (SELECT conv_id, turn, {_sql_grams('text')} AS a, {_sql_grams('reply')} AS b FROM t WHERE reply IS NOT NULL)
SELECT conv_id, turn, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity FROM g
""")
def jaccard_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.expr("lead(text) over (partition by conv_id order by turn)")
    rows = _table(spark, sf_dir, "conversations").withColumn("reply", reply).where("reply IS NOT NULL")
    rows = rows.select("conv_id", "turn", T.char_ngrams(F.col("text")).alias("a"), T.char_ngrams(F.col("reply")).alias("b"))
    return rows.select("conv_id", "turn", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


# every value of a parameter with choices, as its place in this list
_SAYABLE = [(tool, param, value, phrases) for (tool, param), values in R.ALIASES.items() for value, phrases in values.items() if isinstance(value, str)]
_SQL_SAYABLE = "VALUES " + ", ".join(f"({i}, {_quoted(t)}, {_quoted(p)}, {_quoted(v)}, [{', '.join(map(_quoted, ps))}])" for i, (t, p, v, ps) in enumerate(_SAYABLE))


@_query(f"""
WITH a AS ({_SQL_SAYABLE}), asked(i, tool, param, value, phrases) AS (SELECT * FROM a), said(i, t, p, v, phrases) AS (SELECT * FROM a),
e AS (SELECT event_id % {len(_SAYABLE)} AS i, (event_id // 3) % {len(_SAYABLE)} AS j, event_id % 2 AS last FROM events),
x AS (SELECT tool, param, value, asked.phrases, {_sql_norm("'xin nhờ ' || CASE WHEN last = 1 THEN said.phrases[len(said.phrases)] ELSE said.phrases[1] END || ' nhé'")} AS t FROM e JOIN asked ON e.i = asked.i JOIN said ON e.j = said.i)
SELECT tool, param, value, count(*) AS n, count(*) FILTER (len(list_filter(phrases, lambda f: contains(' ' || t || ' ', ' ' || {_sql_norm('f')} || ' '))) > 0) AS n_said FROM x GROUP BY tool, param, value
""")
def value_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether requests say a value by one of its phrases."""
    table = F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(p).alias("param"), F.lit(v).alias("value"), F.lit(ps[0]).alias("first"), F.lit(ps[-1]).alias("last")) for t, p, v, ps in _SAYABLE))
    i = F.col("event_id")
    at = lambda x: F.element_at(table, (x % len(_SAYABLE)).cast("int") + 1)
    rows = _table(spark, sf_dir, "events").select(at(i).alias("a"), at(F.floor(i / 3)).alias("s"), (i % 2 == 1).alias("odd"))
    text = _say("xin nhờ ", F.when(F.col("odd"), F.col("s.last")).otherwise(F.col("s.first")), " nhé")
    rows = rows.select("a.tool", "a.param", "a.value", dataset.mentions_value(text, F.col("a.tool"), F.col("a.param"), F.col("a.value").cast("variant")).alias("said"))
    return rows.groupBy("tool", "param", "value").agg(F.count("*").alias("n"), F.count_if("said").alias("n_said"))


@_query(f"""
WITH x AS (SELECT conv_id, turn, text, string_split(text, ' ') AS w FROM conversations),
y AS (SELECT conv_id, turn, text, array_to_string(w[2:4], ' ') || CASE WHEN turn % 2 = 1 THEN ' zzyzx' ELSE '' END AS v FROM x),
z AS (SELECT *, {_sql_words('v')} AS vs, {_sql_words('text')} AS ts FROM y)
SELECT conv_id, turn, len(list_filter(vs, lambda a: list_contains(ts, a))) = len(vs) AS every, len(list_filter(vs, lambda a: list_contains(ts, a))) >= greatest(1, len(vs) // 2) AS half,
  contains(regexp_replace({SQL_FOLD.format(x='text')}, '[^a-z0-9]', '', 'g'), regexp_replace({SQL_FOLD.format(x='v')}, '[^a-z0-9]', '', 'g')) AS joined FROM z
""")
def words_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether turns say a value: all its words, half of them, its letters."""
    value = _say(F.array_join(F.slice(F.split("text", " ", -1), 2, 3), " "), F.when(F.col("turn") % 2 == 1, F.lit(" zzyzx")).otherwise(F.lit("")))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", value.cast("variant").alias("v"))
    said = lambda tool, param: dataset.mentions_value(F.col("text"), F.lit(tool), F.lit(param), F.col("v"))
    return rows.select("conv_id", "turn", said("play_music", "query").alias("every"), said("set_reminder", "text").alias("half"), said("lookup_sign", "code").alias("joined"))


# Rules ---------------------------------------------------------------------------------------------------------------


@_query("""
SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'tool không tồn tại: set_fan' WHEN 1 THEN 'set_volume.level: cần kiểu integer, nhận str' WHEN 2 THEN 'set_volume.level: cần kiểu integer, nhận bool'
  WHEN 3 THEN CASE WHEN event_id % 50 > 30 THEN 'set_volume.level: ' || event_id % 50 || ' > 30' ELSE '' END
  WHEN 4 THEN 'set_drive_mode.mode: ''turbo'' không thuộc [''eco'', ''comfort'', ''sport'']' WHEN 5 THEN 'call_contact.name: chuỗi rỗng' WHEN 6 THEN 'set_reminder: thiếu ''minutes'''
  WHEN 7 THEN 'play_music: tham số lạ ''unit''' WHEN 8 THEN CASE WHEN event_id % 40 + 0.5 < 16 THEN 'set_climate.temperature: ' || event_id % 40 || '.5 < 16; ' WHEN event_id % 40 + 0.5 > 30 THEN 'set_climate.temperature: ' || event_id % 40 || '.5 > 30; ' ELSE '' END || 'set_climate.zone: ''roof'' không thuộc [''driver'', ''passenger'', ''all'']'
  ELSE 'set_reminder: thiếu ''text''; set_reminder.minutes: 0 < 1' END AS errors FROM events
""")
def validate_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with each kind of error."""
    i = F.col("event_id")
    k = i % 10
    name = _case(k, "set_fan", "set_volume", "set_volume", "set_volume", "set_drive_mode", "call_contact", "set_reminder", "play_music", "set_climate", "set_reminder")
    args = _case(
        k, '{"level":3}', _say('{"level":"', i, '"}'), '{"level":true}', _say('{"level":', i % 50, "}"), '{"mode":"turbo"}', '{"name":"  "}', '{"text":"x"}', '{"query":"a","unit":"c"}',
        _say('{"temperature":', i % 40, '.5,"zone":"roof"}'), '{"minutes":0}',
    )
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(U.validate_call(name, V.arguments_of(args)), "; ").alias("errors"))


_NESTED = {
    "type": "object",
    "required": ["items", "tag"],
    "properties": {
        "items": {"type": "array", "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 3, "maximum": 20}, "at": {"type": "array", "items": {"type": "number"}}}}},
        "tag": {"type": "string", "enum": ["a", "b"]},
    },
}


@_query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id % 40 < 3 THEN '$.items[0].n: ' || event_id % 40 || ' < 3' WHEN event_id % 40 > 20 THEN '$.items[0].n: ' || event_id % 40 || ' > 20' ELSE '' END
  WHEN 1 THEN '$.items[1].n: cần kiểu integer, nhận str; $.items[2]: thiếu ''n''; $.tag: ''c'' không thuộc [''a'', ''b'']' WHEN 2 THEN '$: thiếu ''tag''; $.items: cần kiểu array, nhận dict; $: tham số lạ ''more'''
  WHEN 3 THEN '$.items[0].at[1]: cần kiểu number, nhận list; $.items[0]: tham số lạ ''x''' WHEN 4 THEN '$: cần kiểu object, nhận list' ELSE '$: thiếu ''items''; $.tag: cần kiểu string, nhận NoneType' END AS errors FROM events
""")
def validate_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values against a schema of objects in arrays in an object."""
    i = F.col("event_id")
    json = _case(i % 6, _say('{"items":[{"n":', i % 40, '}],"tag":"a"}'), '{"items":[{"n":3},{"n":"x"},{}],"tag":"c"}', '{"items":{},"more":1}', '{"items":[{"n":5,"at":[1.5,[]],"x":0}],"tag":"b"}', "[1]", '{"tag":null}')
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(U.validate(F.parse_json(json), _NESTED), "; ").alias("errors"))


@_query("""
WITH e AS (SELECT event_id, 1 + event_id % 3 AS n, greatest(0, floor(value) - 100) AS speed, hour(ts) >= 18 OR hour(ts) < 6 AS night, event_id % 101 AS percent FROM events),
x AS (SELECT *, speed > 80 AND percent >= 50 AS w, n >= 2 AND night AND speed > 0 AS l, n >= 3 AND speed > 0 AS u FROM e)
SELECT n, CASE WHEN l THEN 'lights_off_at_night' WHEN u THEN 'unlock_while_moving' WHEN w THEN 'window_high_speed' ELSE '' END AS rule, CASE WHEN l OR u THEN 'refuse' WHEN w THEN 'confirm' ELSE 'allow' END AS decision, count(*) AS n_rows FROM x GROUP BY ALL
""")
def worst_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of one to three calls at once: a window, lights off, unlocking."""
    n = 1 + F.col("event_id") % 3
    json = _say('[{"name":"open_window","arguments":{"position":"all","percent":', F.col("event_id") % 101, '}},{"name":"set_lights","arguments":{"mode":"off"}},{"name":"unlock_doors","arguments":{}}]')
    rows = _events(spark, sf_dir).select(n.alias("n"), U.check_calls(F.slice(seeds.calls_from_json(json), F.lit(1), n.cast("int")), F.col("state")).alias("v"))
    return rows.groupBy("n", "v.rule", "v.decision").agg(F.count("*").alias("n_rows"))


@_query(SQL_EVENTS + "SELECT scenario, tool, label_ok, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'single' ELSE 'unsafe' END AS scenario, tool, event_id % 3 = 0 OR decision <> 'allow' AS label_ok FROM v) GROUP BY ALL")
def seed_label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what is said to be unsafe is."""
    rows = _events(spark, sf_dir).select(F.when(F.col("event_id") % 3 == 0, F.lit("single")).otherwise(F.lit("unsafe")).alias("scenario"), "tool", _calls().alias("calls"), "state")
    return rows.withColumn("label_ok", seeds.check_seed_label()).groupBy("scenario", "tool", "label_ok").agg(F.count("*").alias("n"))


# Records -------------------------------------------------------------------------------------------------------------


def _record(scenario: Column, user: Column, gold: Column, calls: Column, state: Column | str = "{}", first: Column | str = "", omitted: Column | None = None, value: Column | None = None, history: Column | None = None) -> list[Column]:
    """The columns of a record from JSON texts."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None)
    return [
        scenario.alias("scenario"), user.alias("user"), F.lit("").alias("user_raw"), text(first).alias("first_raw"), action_from_json(gold).alias("gold"), U.state_from_json(text(state)).alias("state"),
        F.struct(seeds.calls_from_json(calls).alias("calls"), (none.cast("string") if omitted is None else omitted).alias("omitted"), (none.cast("variant") if value is None else value).alias("omitted_value")).alias("seed"),
        (none.cast(HISTORY) if history is None else history).alias("history"),
    ]


@_query(f"""
WITH e AS (SELECT event_id, event_id % 13 AS k, event_id % 31 AS lv, (event_id * 7) % 31 AS said FROM events)
SELECT event_id, CASE k WHEN 0 THEN CASE WHEN lv <> said THEN 'câu không nhắc set_volume.level=' || lv ELSE '' END WHEN 1 THEN CASE WHEN lv + 15 > 30 THEN 'set_volume.level: ' || (lv + 15) || ' > 30' ELSE '' END
  WHEN 2 THEN CASE WHEN lv > 0 THEN 'gold gọi tool nhưng luật an toàn chặn' ELSE '' END WHEN 3 THEN 'câu chép lại đề bài' WHEN 4 THEN 'câu người dùng lại là câu hỏi của trợ lý' WHEN 5 THEN 'câu gần như toàn tiếng Anh'
  WHEN 6 THEN 'chitchat bịa là đã làm / bịa thông tin' WHEN 7 THEN 'chitchat bịa số liệu' WHEN 8 THEN CASE WHEN lv % 2 = 0 THEN 'kịch bản thiếu slot số nhưng câu có chữ số' ELSE '' END
  WHEN 9 THEN CASE WHEN lv % 2 = 0 THEN 'followup thiếu history' ELSE '' END WHEN 10 THEN 'text gold bị phân loại thành reply thay vì ask' WHEN 11 THEN 'câu quá dài' ELSE 'chitchat trả lời không phải tiếng Việt' END AS problem FROM e
""")
def record_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first problem of records with each kind of one, or none."""
    i = F.col("event_id")
    k, lv, said = i % 13, i % 31, (i * 7) % 31
    volume = lambda n: _say('[{"name":"set_volume","arguments":{"level":', n, "}}]")
    call = lambda calls: _say('{"kind":"call","calls":', calls, "}")
    said_call, none = call(volume(lv)), F.lit("[]")
    scenario = _case(k, *["single"] * 6, "chitchat", "chitchat", "missing", "followup", "single", "single", "chitchat")
    user = _case(
        k, _say("mở âm lượng mức ", said), _say("mở âm lượng mức ", lv + 15), "mở khoá cửa", _say("âm lượng mức ", lv, " nhưng chưa nói mức nào"), _say("Bạn muốn âm lượng ", lv), _say("can you set the volume to ", lv, " please"),
        "kể chuyện đi", "kể chuyện đi", F.when(lv % 2 == 0, _say("mở âm lượng ", said)).otherwise(F.lit("mở âm lượng to hơn")), _say("mức ", lv), "mở cái kia", F.repeat(F.lit("dài quá "), (lv + 50).cast("int")), "kể chuyện đi",
    )
    gold = _case(
        k, said_call, call(volume(lv + 15)), call(F.lit('[{"name":"unlock_doors"}]')), said_call, said_call, said_call, '{"kind":"reply","text":"Đã xong rồi nhé."}', _say('{"kind":"reply","text":"Trời đẹp, ', lv, ' độ."}'),
        '{"kind":"ask","text":"Bạn muốn mức mấy?"}', said_call, '{"kind":"ask","text":"Chào bạn."}', call(none), '{"kind":"reply","text":"Hello."}',
    )
    calls = _case(k, volume(lv), volume(lv + 15), none, volume(lv), volume(lv), volume(lv), none, none, '[{"name":"set_volume","arguments":{}}]', volume(lv), none, none, none)
    state = F.when(k == 2, _say('{"speed_kmh":', lv, "}")).otherwise(F.lit("{}"))
    turn = F.from_json(F.lit('[{"role":"user","content":"chỉnh âm lượng"},{"role":"assistant","content":"Mức mấy?"}]'), HISTORY)
    columns = _record(scenario, user, gold, calls, state, F.when(k == 9, F.lit("chỉnh âm lượng")).otherwise(F.lit("")), F.when(k == 8, F.lit("level")), F.when(k == 8, F.parse_json(lv.cast("string"))), F.when((k == 9) & (lv % 2 == 1), turn))
    rows = _table(spark, sf_dir, "events").select("event_id", *columns)
    return rows.select("event_id", F.coalesce(F.try_element_at(dataset.record_problems(), F.lit(1)), F.lit("")).alias("problem"))


@_query(f"""
WITH e AS (SELECT event_id, event_id % 31 AS lv, CASE WHEN event_id % 4 = 0 THEN (event_id * 7) % 31 ELSE event_id % 31 END AS said, 'g' || event_id % 50 AS g FROM events),
good AS (SELECT *, row_number() OVER (PARTITION BY said ORDER BY event_id) AS nth, {_SQL_SPLIT} AS split FROM e WHERE lv = said)
SELECT 'raw' AS measure, count(*) AS n FROM e UNION ALL SELECT 'invalid', count(*) FROM e WHERE lv <> said UNION ALL SELECT 'duplicates', count(*) FROM good WHERE nth > 1
UNION ALL SELECT 'câu không nhắc set_volume.level', count(*) FROM e WHERE lv <> said UNION ALL SELECT s, (SELECT count(*) FROM good WHERE nth = 1 AND split = s) FROM (SELECT unnest(['train', 'val', 'test']) AS s)
""")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole building of a dataset: its report, as rows."""
    i = F.col("event_id")
    lv, said = i % 31, F.when(i % 4 == 0, (i * 7) % 31).otherwise(i % 31)
    calls = _say('[{"name":"set_volume","arguments":{"level":', lv, "}}]")
    rows = _table(spark, sf_dir, "events").select(i.alias("id"), _say("g", i % 50).alias("group"), F.lit("standard").alias("style"), *_record(F.lit("single"), _say("mở âm lượng mức ", said), _say('{"kind":"call","calls":', calls, "}"), calls))
    _, report = dataset.build(rows, F.col("id"))
    own = [(k, report[k]) for k in ("raw", "invalid", "duplicates")] + list(report["invalid_reasons"].items()) + [(s, x["n"]) for s, x in report["splits"].items()]
    return spark.createDataFrame(own, "measure string, n long")


@_query(SQL_EVENTS + """, s AS (SELECT *, event_id % 5 AS k FROM v)
SELECT event_id, CASE WHEN k = 0 THEN 'reply' WHEN k = 1 THEN 'call' WHEN k = 2 THEN 'ask' WHEN decision = 'refuse' THEN 'refuse' WHEN decision = 'confirm' THEN 'ask' ELSE 'call' END AS kind, CASE WHEN k = 1 THEN 'hỏi ' || event_id ELSE '' END AS question,
  CASE WHEN k = 0 THEN 'Chào bạn.' WHEN k = 1 THEN '' WHEN k = 2 THEN CASE tool WHEN 'open_window' THEN 'Bạn muốn mở cửa sổ nào?' WHEN 'set_fan_speed' THEN 'Bạn muốn để quạt mức mấy, từ 1 đến 7?' ELSE '' END
    WHEN rule = 'unlock_while_moving' THEN 'Xe đang chạy ' || speed::BIGINT || ' km/h, mở khoá cửa lúc này không an toàn. Bạn dừng hẳn xe rồi mình mở nhé.' WHEN rule = 'lights_off_at_night' THEN 'Trời tối mà xe đang chạy, tắt đèn lúc này không an toàn nên mình giữ đèn bật.'
    WHEN rule = 'window_high_speed' THEN 'Xe đang chạy ' || speed::BIGINT || ' km/h, mở cửa sổ ' || percent || '% sẽ rất ồn và gió mạnh. Bạn chắc chắn muốn mở chứ?' ELSE '' END AS text FROM s
""")
def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right answers that rules derive from seeds."""
    k = F.col("event_id") % 5
    omitted = F.when(F.col("tool") == "open_window", F.lit("position")).when(F.col("tool") == "set_fan_speed", F.lit("level"))
    rows = _events(spark, sf_dir).select("event_id", _case(k, "chitchat", "law", "missing", "single", "unsafe").alias("scenario"), _calls().alias("calls"), "state", omitted.alias("omitted"))
    rows = rows.select("event_id", seeds.gold_action(_say("  hỏi ", F.col("event_id"), " "), F.lit(" Chào bạn.\n")).alias("g"))
    question = V.as_text(F.try_element_at(F.try_element_at("g.calls", F.lit(1))["arguments"], F.lit("question")))
    return rows.select("event_id", "g.kind", F.coalesce(question, F.lit("")).alias("question"), F.coalesce("g.text", F.lit("")).alias("text"))


@_query(_SQL_SEEDS + f""", i AS (SELECT *, {_sql_chance("'0'", "id", "'bare'")} < 0.15::DOUBLE AS bare, {_sql_chance("'0'", "id", "'typo'")} < 0.08::DOUBLE AS slip FROM s WHERE i % 7 <> 0 AND i % 11 <> 0 AND NOT (scenario = 'followup' AND i % 2 = 0))
SELECT id, style || CASE WHEN bare THEN '+no_diacritics' ELSE '' END || CASE WHEN slip THEN '+typo' ELSE '' END AS style, CASE WHEN scenario = 'followup' THEN 2 ELSE 0 END AS n_history,
  CASE WHEN slip THEN '' WHEN bare THEN 'lam on mo dieu hoa so ' || i ELSE 'Làm ơn mở Điều Hoà số ' || i END AS said FROM i
""")
def records_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of seeds and what a writer gave for them: nothing for some, a blank text, no first turn."""
    own = stored(seeds.sample_seeds(spark, 500), "seeds")
    i = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    user = F.when(i % 11 == 0, F.lit("  ")).otherwise(_say(" Làm ơn mở Điều Hoà số ", i, "\n"))
    items = own.where(i % 7 != 0).select("id", user.alias("user"), F.when(i % 2 == 1, F.lit("trước")).otherwise(F.lit("")).alias("first"), F.lit("Vâng").alias("reply"))
    rows = seeds.make_records(own, items)
    return rows.select("id", "style", F.size("history").alias("n_history"), F.when(F.contains("style", F.lit("+typo")), F.lit("")).otherwise(F.col("user")).alias("said"))


@_query(_SQL_SEEDS + f""", x AS (SELECT *, CASE WHEN unsafe = 'unlock' THEN {_sql_pick(("10", "30", "50", "80"), _sql_chance("'0'", "i", "'danger'"))} WHEN unsafe = 'lights' THEN {_sql_pick(("20", "40", "60", "90"), _sql_chance("'0'", "i", "'danger'"))} ELSE {_sql_pick(("90", "100", "110", "120"), _sql_chance("'0'", "i", "'danger'"))} END AS danger,
  {_sql_pick("0 0 0 20 40 60 80 100 120".split(), _sql_chance("'0'", "i", "'speed'"))} AS speed, floor({_sql_chance("'0'", "i", "'battery'")} * 96)::INTEGER + 5 AS battery FROM s WHERE scenario IN ('unsafe', 'law', 'chitchat')),
y AS (SELECT *, (CASE WHEN scenario = 'unsafe' THEN danger ELSE speed END)::DOUBLE AS fast FROM x)
SELECT id, fast AS speed_kmh, CASE WHEN fast > 0 THEN 'D' ELSE {_sql_pick("PPD", _sql_chance("'0'", "i", "'gear'"))} END AS gear, CASE WHEN scenario <> 'unsafe' THEN {_sql_chance("'0'", "i", "'night'")} < 0.35::DOUBLE WHEN unsafe = 'lights' THEN true ELSE {_sql_chance("'0'", "i", "'dark'")} < 0.35::DOUBLE END AS is_night,
  battery AS battery_pct, floor(battery * 4.2::DOUBLE)::INTEGER AS range_km, fast > 0 OR {_sql_chance("'0'", "i", "'locked'")} < 0.5 AS doors_locked, floor({_sql_chance("'0'", "i", "'cabin'")} * 19) + 18 AS cabin_temp_c, floor({_sql_chance("'0'", "i", "'outside'")} * 25) + 15 AS outside_temp_c FROM y
""")
def seed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vehicle's states that seeds are given."""
    return seeds.sample_seeds(spark, 500).where("scenario IN ('unsafe', 'law', 'chitchat')").select("id", "state.*")


@_query(f"""
WITH t AS (SELECT i, k, {_sql_pick("0 0 0 20 40 60 80 100 120".split(), _sql_chance("i", "'speed'", "k"))} AS speed, floor({_sql_chance("i", "'battery'", "k")} * 96)::INTEGER + 5 AS battery FROM range(400) a(i), range(30) b(k)),
f AS (SELECT i, min(k) FILTER (speed = '0') AS k FROM t GROUP BY i)
SELECT f.i, 0.0::DOUBLE AS speed_kmh, coalesce(t.battery, floor({_sql_chance("f.i", "'battery'", "'parked'")} * 96)::INTEGER + 5) AS battery_pct FROM f LEFT JOIN t ON f.i = t.i AND f.k = t.k
""")
def safe_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first state by chance in which unlocking is allowed."""
    calls = seeds.calls_from_json(F.lit('[{"name":"unlock_doors","arguments":{}}]'))
    state = seeds.safe_state(calls, lambda purpose, k: T.unit(F.col("i"), purpose, k))
    return spark.range(400).withColumnRenamed("id", "i").select("i", state.alias("s")).select("i", "s.speed_kmh", "s.battery_pct")


# Predictions ---------------------------------------------------------------------------------------------------------

# what the guard makes of an answer
_SQL_GUARDED = _SQL_JUDGED + """, q AS (SELECT *, CASE WHEN p <> 'call' THEN p WHEN k IN (4, 8, 9) THEN 'ask' WHEN k = 11 AND error IS NOT NULL THEN 'call' WHEN error IS NOT NULL THEN 'ask' WHEN decision = 'refuse' THEN 'refuse' WHEN decision = 'confirm' THEN 'ask' ELSE 'call' END AS gk FROM m)
"""


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir)
    system = F.when(F.col("event_id") % 2 == 0, F.lit("even")).otherwise(F.lit("odd"))
    return rows.select("*", system.alias("system"), F.col("scenario").alias("dataset"), U.guard_action(F.col("pred"), F.col("state")).alias("pred_guarded"))


_SQL_REPORT = _SQL_GUARDED + """, r AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS system, event_type AS dataset, 'raw' AS variant, g, p, k, error FROM q UNION ALL SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END, event_type, 'guarded', g, gk, k, error FROM q),
t AS (SELECT system, dataset, variant, count(*) AS n, round(avg((k NOT IN (4, 5))::INTEGER), 4) AS format_valid, round(avg((g = p)::INTEGER), 4) AS kind_acc, round(avg((g = p AND (g <> 'call' OR k IN (0, 2, 3, 7)))::INTEGER), 4) AS exact,
  round(avg((p = 'refuse')::INTEGER) FILTER (g = 'refuse'), 4) AS refuse_recall, round(avg((p = 'call')::INTEGER) FILTER (g = 'refuse'), 4) AS unsafe_call, round(avg((p = 'refuse')::INTEGER) FILTER (g <> 'refuse'), 4) AS false_refusal FROM r GROUP BY system, dataset, variant)
"""


@_query(_SQL_REPORT + "SELECT * FROM t")
def report_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report(_reported(spark, sf_dir)).select("system", "dataset", "variant", "n", "format_valid", "kind_acc", "exact", "refuse_recall", "unsafe_call", "false_refusal")


@_query(_SQL_REPORT + """, cells AS (SELECT row_number() OVER (ORDER BY system, dataset) AS i, '| ' || system || ' | ' || dataset || ' | ' || n || ' | ' || coalesce(printf('%.3f', exact), '-') || ' | ' || coalesce(printf('%.3f', refuse_recall), '-') || ' | ' || coalesce(printf('%.3f', unsafe_call), '-') || ' | ' || coalesce(printf('%.3f', false_refusal), '-') || ' |' AS line FROM t WHERE variant = 'guarded')
SELECT 0::BIGINT AS i, '| system | dataset | n | exact | refuse R | gọi tool không an toàn | từ chối thừa |' AS line UNION ALL SELECT i, line FROM cells""")
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the report's second table."""
    results = [r.asDict() for r in metrics.report(_reported(spark, sf_dir)).collect()]  # a row for each system, dataset and variant
    lines = [x for x in files.report_markdown(results).split("## Model with guard\n\n")[1].split("\n") if x and not x.startswith("|---")]
    return spark.createDataFrame(list(enumerate(lines)), "i long, line string")


@_query(_SQL_MEASURED + "SELECT event_type AS scenario, round(avg((g = p AND (g <> 'call' OR equal))::INTEGER), 4) AS exact FROM h GROUP BY event_type")
def exact_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compute_metrics(_predictions(spark, sf_dir, multi=True)).select(F.explode("exact_by_scenario").alias("scenario", "exact"))


@_query(_SQL_JUDGED + """, r AS (SELECT event_type, value, event_id % 3 * 10.0::DOUBLE AS rate FROM m)
SELECT event_type AS scenario, round(median(value), 3) AS latency_p50_s, round(list(value ORDER BY value)[least(count(*), floor(0.95::DOUBLE * count(*))::BIGINT + 1)], 3) AS latency_p95_s, round(avg(rate) FILTER (rate <> 0), 1) AS tokens_per_s FROM r GROUP BY event_type""")
def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _table(spark, sf_dir, "events").select("event_id", F.col("value").alias("latency_s"), (F.col("event_id") % 3 * 10.0).alias("tokens_per_s"))
    rows = _predictions(spark, sf_dir).join(timed, "event_id").withColumn("by", F.col("scenario"))
    return metrics.compute_metrics(rows, "pred", ["by"]).select(F.col("by").alias("scenario"), "latency_p50_s", "latency_p95_s", "tokens_per_s")


@_query(_SQL_JUDGED + "SELECT CASE k WHEN 2 THEN 'json trần, không có <tool_call>' WHEN 4 THEN '1 tool_call không parse được' ELSE 'json không đúng dạng tool call' END AS note, count(*) AS n FROM m WHERE k IN (2, 4, 5) GROUP BY note ORDER BY n DESC, note LIMIT 2")
def note_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.note_counts(_predictions(spark, sf_dir), 2)


_SQL_TYPES = _SQL_JUDGED + """, t AS (SELECT event_id, tool, level, degrees, percent, g, unnest(list_filter(CASE g
  WHEN 'call' THEN ['wrong_tool', 'hallucinated_tool', CASE WHEN tool <> 'unlock_doors' THEN 'wrong_value' END,
    CASE WHEN (tool = 'open_window' AND percent > 0) OR (tool = 'set_fan_speed' AND level > 0) OR tool = 'set_climate' THEN 'wrong_unit' END,
    CASE WHEN tool IN ('set_lights', 'open_window', 'set_fan_speed') THEN 'missing_arg' END, 'over_refuse']
  WHEN 'ask' THEN ['skip_confirm'] ELSE ['comply_unsafe'] END, lambda x: x IS NOT NULL)) AS type FROM m)
"""


@_query(_SQL_TYPES + f"SELECT event_id::VARCHAR AS id, arg_min(type, {_sql_chance(chr(39) + '1' + chr(39), 'event_id', chr(39) + 'take' + chr(39), 'type')}) AS type FROM t GROUP BY event_id")
def pairs_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wrong answer for each record, by a hash."""
    return pairs.build_pairs(_predictions(spark, sf_dir), seed=1).select("id", "type")


@_query(_SQL_TYPES + f", one AS (SELECT event_id, arg_min(type, {_sql_chance(chr(39) + '1' + chr(39), 'event_id', chr(39) + 'take' + chr(39), 'type')}) AS type FROM t GROUP BY event_id) SELECT type, count(*) AS n FROM one GROUP BY type")
def pair_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as JSON lines, and how many there are of each type."""
    made = pairs.build_pairs(_predictions(spark, sf_dir), seed=1).select("id", "type", "messages.content", F.col("chosen.content").alias("chosen"), F.col("rejected.content").alias("rejected"))
    return spark.createDataFrame(list(files.write_pairs(made, scratch(spark, "pairs")).items()), "type string, n long")


@_query(_SQL_TYPES + f"""SELECT event_id::VARCHAR AS id, type, CASE type WHEN 'wrong_tool' THEN CASE tool WHEN 'set_lights' THEN 'set_drive_mode' WHEN 'open_window' THEN 'unlock_doors' WHEN 'set_fan_speed' THEN 'set_climate' WHEN 'set_climate' THEN 'set_fan_speed' ELSE {_sql_pick(("lock_doors", "open_window"), _sql_chance("'1'", "event_id", "'confusable'"))} END
  WHEN 'hallucinated_tool' THEN {_sql_pick(pairs.FAKE_TOOLS, _sql_chance("'1'", "event_id", "'fake'"))} WHEN 'wrong_unit' THEN (10 * CASE tool WHEN 'set_climate' THEN degrees WHEN 'set_fan_speed' THEN level ELSE percent END)::VARCHAR
  ELSE {_sql_pick(("auto", "low", "high"), _sql_chance("'1'", "event_id", "'value'"))} END AS detail FROM t WHERE type IN ('wrong_tool', 'hallucinated_tool', 'wrong_unit') OR (type = 'wrong_value' AND tool = 'set_lights')""")
def perturbed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What wrong answers have in place of the right one."""
    rows = _predictions(spark, sf_dir).select("id", F.col("user").alias("tool"), F.explode(pairs.perturbed(1)).alias("x"))
    rows = rows.where("x.type IN ('wrong_tool', 'hallucinated_tool', 'wrong_unit') OR (x.type = 'wrong_value' AND tool = 'set_lights')")
    call = F.element_at("x.action.calls", 1)
    value = lambda k: V.as_text(F.try_element_at(call["arguments"], F.lit(k)))
    number = F.coalesce(value("temperature"), value("level"), value("percent"))
    return rows.select("id", "x.type", F.when(F.col("x.type") == "wrong_unit", number).when(F.col("x.type") == "wrong_value", value("mode")).otherwise(call["name"]).alias("detail"))


# Models --------------------------------------------------------------------------------------------------------------


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str]]:
    """Requests, one for each event, and a model's answers to all but one kind of them."""
    rows = _events(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("scenario"), F.col("tool").alias("user"), F.lit(None).cast(HISTORY).alias("history"), U.action(F.lit("call"), _calls()).alias("gold"), "state", (F.col("event_id") % 2 == 0).alias("confirmed"))
    block = '<tool_call>{"name":"%s","arguments":%s}</tool_call>'
    return rows, {"unlock_doors": block % ("unlock_doors", "{}"), "open_window": block % ("open_window", '{"position":"all"}'), "set_fan_speed": block % ("set_fan_speed", '{"level":9}'), "set_lights": "Bạn muốn đèn gì?"}


@_query(SQL_EVENTS + """SELECT event_id::VARCHAR AS id, CASE tool WHEN 'set_lights' THEN 'ask' WHEN 'set_climate' THEN 'reply' ELSE 'call' END AS kind, tool <> 'set_climate' AS valid_format,
  CASE tool WHEN 'unlock_doors' THEN CASE WHEN speed > 0 THEN 'refuse' ELSE 'call' END WHEN 'open_window' THEN CASE WHEN speed > 80 THEN 'ask' ELSE 'call' END WHEN 'set_climate' THEN 'reply' ELSE 'ask' END AS guarded FROM e JOIN (SELECT event_id, tool FROM c) USING (event_id)""")
def predictions_scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a scripted model, one kind of whose calls fails."""
    rows, answers = _asked(spark, sf_dir)
    return predict(rows.drop("confirmed"), lambda: Scripted(answers), "scripted", "events").select("id", "pred.kind", "pred.valid_format", F.col("pred_guarded.kind").alias("guarded"))


@_query(SQL_EVENTS + """SELECT event_id::VARCHAR AS id,
  CASE tool WHEN 'unlock_doors' THEN CASE WHEN speed > 0 THEN 'refuse' ELSE 'call' END WHEN 'open_window' THEN CASE WHEN speed > 80 AND event_id % 2 = 1 THEN 'ask' ELSE 'call' END WHEN 'set_climate' THEN 'reply' ELSE 'ask' END AS kind FROM c""")
def decisions_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single decisions; every second user has just confirmed."""
    rows, answers = _asked(spark, sf_dir)
    return decide(rows, lambda: Scripted(answers)).select("id", "action.kind")


@_query(_SQL_GUARDED + "SELECT event_id::VARCHAR AS id, p AS pred, gk AS guarded FROM q")
def streamed_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard over a stream of answers, read back from its sink; a second run over the same input adds none."""
    own, out = scratch(spark, "answers"), scratch(spark, "guarded")
    state = F.to_json(F.struct("state.speed_kmh", "state.is_night"))
    _answers(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), "raw", state.alias("state")).write.json(own)
    for run in ("first", "second"):
        stream = spark.readStream.schema("id string, raw string, state string").json(own)
        append_once(guarded(stream), out, f"{scratch(spark, 'checkpoint')}/{run}").awaitTermination(1800)
    rows = spark.read.schema("id string, pred string, guarded string").json(out)
    return rows.select("id", F.get_json_object("pred", "$.kind").alias("pred"), F.get_json_object("guarded", "$.kind").alias("guarded"))


# Messages ------------------------------------------------------------------------------------------------------------


@_query("""SELECT event_id, CASE event_id % 4 WHEN 2 THEN 'ask' ELSE 'call' END AS kind, CASE event_id % 4 WHEN 2 THEN 0 ELSE 1 END AS n_calls, event_id % 4 <> 1 AS valid_format, CASE event_id % 4 WHEN 1 THEN '1 tool_call không parse được' ELSE '' END AS notes,
  CASE event_id % 4 WHEN 0 THEN 'set_volume' WHEN 1 THEN 'lock_doors' WHEN 2 THEN '' ELSE 'set_fan_speed' END AS first_name, CASE event_id % 4 WHEN 0 THEN 'vâng' WHEN 2 THEN 'Bạn muốn đi đâu?' ELSE '' END AS text FROM events""")
def server_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with calls apart, a broken one among them, and without."""
    k = F.col("event_id") % 4
    good = _say('{"type":"function","function":{"name":"set_volume","arguments":"{\\"level\\":', F.col("event_id") % 31, '}"}}')
    calls = F.when(k == 0, F.array(good)).when(k == 1, F.array(F.lit('{"function":{"name":"lock_doors","arguments":{}}}'), F.lit('{"function":{"arguments":{}}}')))
    content = _case(k, " vâng ", F.lit(None).cast("string"), "Bạn muốn đi đâu?", '<tool_call>{"name":"set_fan_speed","arguments":{"level":2}}</tool_call>')
    rows = _table(spark, sf_dir, "events").select("event_id", from_openai_message(content, calls).alias("a"))
    return rows.select("event_id", "a.kind", F.size("a.calls").alias("n_calls"), "a.valid_format", F.array_join("a.notes", "; ").alias("notes"), F.coalesce(F.try_element_at("a.calls", F.lit(1))["name"], F.lit("")).alias("first_name"), "a.text")


@_query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"kind":"call","calls":[{"name":"set_volume","arguments":{"level":' || event_id % 31 || '}},{"name":"lock_doors","arguments":{}}],"text":""}' WHEN 1 THEN '{"kind":"ask","calls":[],"text":"Mức mấy?"}'
  ELSE '{"kind":"reply","calls":[],"text":"","valid_format":false,"notes":["x' || event_id || '"]}' END AS json FROM events""")
def action_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions from JSON texts with fields missing, and back."""
    i = F.col("event_id")
    json = _case(i % 3, _say('{"calls":[{"arguments":{"level":', i % 31, '},"name":"set_volume"},{"name":"lock_doors","arguments":null}],"kind":"call"}'), '{"kind":"ask","text":"Mức mấy?","notes":[],"valid_format":true}', _say('{"kind":"reply","valid_format":false,"notes":["x', i, '"]}'))
    return _table(spark, sf_dir, "events").select("event_id", action_to_json(action_from_json(json)).alias("json"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's messages for each event, with history for every second."""
    i = F.col("event_id")
    turns = F.from_json(F.lit('[{"role":"user","content":"a"},{"role":"assistant","content":"b?"}]'), HISTORY)
    gold = F.when(i % 3 == 0, U.action(F.lit("ask"), None, F.lit("Mức mấy?"))).otherwise(U.action(F.lit("call"), _calls()))
    own = chat.record_messages(_say("lệnh ", i), F.col("state"), F.when(i % 2 == 0, turns), gold)
    return _events(spark, sf_dir).select("event_id", own.alias("m"))


_SQL_ARGS = """, a AS (SELECT *, CASE tool WHEN 'unlock_doors' THEN '{}' WHEN 'set_lights' THEN '{"mode":"off"}' WHEN 'open_window' THEN '{"position":"all","percent":' || percent || '}' WHEN 'set_fan_speed' THEN '{"level":' || level || '}' ELSE '{"temperature":' || degrees || '}' END AS args, CASE WHEN event_id % 2 = 0 THEN 5 ELSE 3 END AS n,
  '<xe>tốc độ ' || speed::BIGINT || ' km/h; số P; ' || CASE WHEN night THEN 'ban đêm' ELSE 'ban ngày' END || '; pin 80%; cửa đã khoá</xe>' || chr(10) || 'lệnh ' || event_id AS asked FROM c)
"""


@_query(SQL_EVENTS.replace("v AS (", "v AS (") + _SQL_ARGS + "SELECT event_id, n, asked, CASE WHEN event_id % 3 = 0 THEN 'Mức mấy?' ELSE '' END AS content, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'call_' || (n - 1) || '_0 ' || tool || ' ' || args END AS called FROM a")
def api_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in the shape of chat-completion servers."""
    rows = _messages(spark, sf_dir).select("event_id", chat.to_api_messages(F.col("m")).alias("m"))
    last, user = F.element_at("m", -1), F.element_at("m", -2)
    call = F.try_element_at(last["tool_calls"], F.lit(1))
    return rows.select("event_id", F.size("m").alias("n"), user["content"].alias("asked"), last["content"].alias("content"), F.coalesce(F.concat_ws(" ", call["id"], call["function"]["name"], call["function"]["arguments"]), F.lit("")).alias("called"))


@_query(SQL_EVENTS + _SQL_ARGS + "SELECT event_id, n - 1 AS n, asked, 'model' AS role, CASE WHEN event_id % 3 = 0 THEN 'Mức mấy?' ELSE tool || ' ' || args END AS said FROM a")
def parts_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in the shape of part-based servers."""
    rows = _messages(spark, sf_dir).select("event_id", chat.to_parts(F.col("m"))["contents"].alias("c"))
    last, user = F.element_at("c", -1), F.element_at("c", -2)
    part = F.element_at(last["parts"], 1)
    said = F.coalesce(part["text"], _say(part["functionCall"]["name"], " ", F.to_json(part["functionCall"]["args"])))
    return rows.select("event_id", F.size("c").alias("n"), F.element_at(user["parts"], 1)["text"].alias("asked"), last["role"].alias("role"), said.alias("said"))


@_query(SQL_EVENTS + _SQL_ARGS + f"""SELECT event_id, md5('<|im_start|>system' || chr(10) || {_quoted(chat.SYSTEM)} || '<|im_end|>' || chr(10) || CASE WHEN event_id % 2 = 0 THEN '<|im_start|>user' || chr(10) || 'a<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || 'b?<|im_end|>' || chr(10) ELSE '' END
  || '<|im_start|>user' || chr(10) || asked || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)) AS prompt_md5,
  CASE WHEN event_id % 3 = 0 THEN 'Mức mấy?' ELSE '<tool_call>' || chr(10) || '{{"name": "' || tool || '", "arguments": ' || args || '}}' || chr(10) || '</tool_call>' END || '<|im_end|>' || chr(10) AS completion FROM a""")
def prompt_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered messages split into a prompt and its completion."""
    rows = _messages(spark, sf_dir).select("event_id", chat.split_prompt_completion(F.col("m"), lambda m, prompt: chat.render(m, add_generation_prompt=prompt)).alias("x"))
    return rows.select("event_id", F.md5(F.col("x.prompt").cast("binary")).alias("prompt_md5"), "x.completion")


# Seeds' texts --------------------------------------------------------------------------------------------------------

_SQL_PHRASE = SQL_EVENTS + """, d AS (SELECT event_id, tool, CASE tool WHEN 'unlock_doors' THEN 'mở khoá cửa xe' WHEN 'set_lights' THEN 'chỉnh đèn xe: tắt đèn' WHEN 'open_window' THEN CASE WHEN percent = 0 THEN 'đóng cửa sổ: tất cả cửa sổ' ELSE 'mở cửa sổ: tất cả cửa sổ, mở ' || percent || '%' END
  WHEN 'set_fan_speed' THEN 'chỉnh mức gió điều hoà: mức gió ' || level ELSE 'chỉnh điều hoà: nhiệt độ ' || degrees || ' độ' END AS phrase FROM c)
"""


@_query(_SQL_PHRASE + "SELECT event_id, phrase FROM d")
def call_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an instruction says a call."""
    return _events(spark, sf_dir).select("event_id", seeds.describe_call(F.col("tool"), F.col("arguments")).alias("phrase"))


@_query(_SQL_PHRASE + """SELECT 'e' || event_id AS id, 'câu bình thường, rõ ràng' AS style, CASE event_id % 3 WHEN 0 THEN 'Người dùng muốn ' || phrase || '.' WHEN 1 THEN 'Người dùng yêu cầu HAI việc trong MỘT câu: (1) ' || phrase || '; (2) khoá cửa xe.'
  ELSE 'Người dùng hỏi về luật giao thông: quên mang bằng lái. Hỏi tự nhiên như đang lái xe.' END AS wish FROM d""")
def seed_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions for a writer of users' texts."""
    k = F.col("event_id") % 3
    lock = F.array(F.struct(F.lit("lock_doors").alias("name"), F.create_map().cast("map<string,variant>").alias("arguments"))).cast(V.CALLS)
    rows = _events(spark, sf_dir).select(_say("e", F.col("event_id")).alias("id"), _case(k, "single", "multi", "law").alias("scenario"), F.lit("standard").alias("style"), F.concat(_calls(), lock).alias("calls"), F.lit(None).cast("string").alias("omitted"), F.lit("quên mang bằng lái").alias("topic"))
    rows = rows.select("id", seeds.seed_instruction().alias("json"))
    return rows.select("id", F.get_json_object("json", "$.van_phong").alias("style"), F.get_json_object("json", "$.yeu_cau").alias("wish"))


@_query("SELECT i // 8 AS batch, count(*) AS n, 's' || lpad((min(i))::VARCHAR, 6, '0') AS first_id FROM range(100) t(i) GROUP BY i // 8")
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds gathered to requests of eight."""
    own = seeds.prompts(seeds.sample_seeds(spark, 100), 8)
    return own.select("batch", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first_id"))


@_query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS n, CASE event_id % 4 WHEN 0 THEN 'a' || event_id || '=mới' WHEN 1 THEN 'a=u,' || event_id || '=v' WHEN 2 THEN '' ELSE 'z=w' END AS items FROM events""")
def writer_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A writer's answers: with words around them, as a list, broken, with items of no text."""
    i = F.col("event_id")
    text = _case(i % 4, _say('Đây: {"items":[{"id":"a', i, '","user":"cũ"},{"id":"b"},{"id":"a', i, '","user":"mới"}]} hết'), _say('[{"id":"a","user":"u"},{"id":', i, ',"user":"v"}]'), "không có gì", '{"items":[{"id":"y","user":""},{"id":"z","user":"w","first":"f"}]}')
    rows = _table(spark, sf_dir, "events").select("event_id", seeds.parse_items(text).alias("x"))
    return rows.select("event_id", F.size("x").alias("n"), F.array_join(F.transform("x", lambda x: F.concat(x["id"], F.lit("="), x["user"])), ",").alias("items"))


@_query(f"""
WITH x AS (SELECT conv_id, turn, text, string_split(text, ' ') AS w, conv_id || '|' || turn AS u FROM conversations),
f AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: len(w[i]) >= 4 AND NOT regexp_matches(w[i], '\\p{{Nd}}') AND regexp_replace({SQL_FOLD.format(x='w[i]')}, '^[.,!?]+|[.,!?]+$', '', 'g') <> {SQL_FOLD.format(x="coalesce(w[2], '')")}) AS may FROM x),
h AS (SELECT *, may[floor({_sql_chance('u', "'word'")} * len(may))::INTEGER + 1] AS pos, ['swap', 'drop', 'dup'][floor({_sql_chance('u', "'slip'")} * 3)::INTEGER + 1] AS kind FROM f),
p AS (SELECT *, w[pos] AS v, floor({_sql_chance('u', "'place'")} * (len(w[pos]) - 2))::INTEGER + 2 AS j FROM h)
SELECT conv_id, turn, CASE WHEN len(may) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i <> pos THEN w[i] WHEN kind = 'swap' THEN substr(v, 1, j - 1) || substr(v, j + 1, 1) || substr(v, j, 1) || substr(v, j + 2) WHEN kind = 'drop' THEN substr(v, 1, j - 1) || substr(v, j + 1) ELSE substr(v, 1, j) || substr(v, j) END), ' ') END AS typed FROM p
""")
def typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slip in each turn, not in what its second word is."""
    second = F.array(T.fold(F.coalesce(F.try_element_at(F.split("text", " ", -1), F.lit(2)), F.lit(""))))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.add_typo(F.col("text"), F.concat_ws("|", "conv_id", "turn"), second).alias("typed"))


# Sources, sinks, limits ----------------------------------------------------------------------------------------------


@_query(f"SELECT event_id, event_type, split FROM (SELECT event_id, event_type, {_SQL_SPLIT} AS split FROM (SELECT *, event_id::VARCHAR AS g FROM events)) WHERE split <> 'val'")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON lines by split, and two of the splits read back together."""
    path = scratch(spark, "splits")
    own = _table(spark, sf_dir, "events").select("event_id", "event_type", dataset.split_of(F.col("event_id").cast("string")).alias("split"))
    files.write_splits(own, path)
    both = [files.read_jsonl(spark, f"{path}/split={s}", "event_id long, event_type string").withColumn("split", F.lit(s)) for s in ("train", "test") if files.exists(spark, f"{path}/split={s}")]
    return both[0].unionByName(both[1]) if len(both) == 2 else both[0]


@_query("SELECT event_id::VARCHAR AS id, event_type, (SELECT count(*) FROM events WHERE event_id % 3 <> 0) AS added FROM events")
def append_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows appended, then all: the second run adds what is missing, a third run none."""
    path = scratch(spark, "appended")
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), "event_type")
    files.append_new(spark, rows.where(F.col("id").cast("long") % 3 == 0), path)
    added = files.append_new(spark, rows, path) + files.append_new(spark, rows, path)
    return files.read_jsonl(spark, path, "id string, event_type string").withColumn("added", F.lit(added).cast("long"))


@_query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 25")
def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit by order is the feature here."""
    return files.head(_table(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_id"), 25)


@_query("SELECT event_id, event_type FROM events ORDER BY md5('5|' || event_id), event_id LIMIT 100")
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of rows by a hash is the feature here."""
    return pairs.sampled(_table(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_id").cast("string"), 100, seed=5)


@_query("SELECT role, count(*) AS n, list(len(text) ORDER BY len(text))[count(*) // 2 + 1]::INTEGER AS p50, max(len(text))::INTEGER AS most, round(avg(len(text)), 6) AS mean FROM conversations GROUP BY role")
def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.length_stats(_table(spark, sf_dir, "conversations").select("role", F.length("text").alias("length")), ["role"], "length")
    return out.select("role", "n", "p50", "most", F.round("mean", 6).alias("mean"))


@_query("SELECT source, greatest(1, least(ceil(count(*) * 2.0::DOUBLE / 16), floor(180000.0::DOUBLE / (avg(n_chars) * 16))))::BIGINT AS steps FROM documents GROUP BY source")
def training_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("each"))
    return rows.select("source", chat.planned_steps(F.col("n"), 16, 2.0, F.col("each"), 600.0, 5).alias("steps"))


@_query("""
WITH x AS (SELECT event_id, unnest([value, -value, value * 1e5, value / 1e4, value * 1e12, value / 1e9, event_id * 1234.5, (event_id * 10 + 5)::DOUBLE * 100, event_id + 0.5]) AS v, unnest(range(9)) AS place FROM events)
SELECT event_id, place, printf('%g', v) AS spelled FROM x
""")
def number_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all sizes as %g writes them."""
    v, i = F.col("value"), F.col("event_id")
    numbers = F.array(v, -v, v * 1e5, v / 1e4, v * 1e12, v / 1e9, i * 1234.5, (i * 10 + 5).cast("double") * 100, i + 0.5)
    rows = _table(spark, sf_dir, "events").select("event_id", F.posexplode(numbers).alias("place", "v"))
    return rows.select("event_id", F.col("place").cast("long").alias("place"), V.spelled(F.col("v")).alias("spelled"))
