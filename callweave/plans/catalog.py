"""The registered queries of the engine's operators over the driver's tables, with the SQL that gives the same rows.

The tables hold no tool calls, so calls, states and answers are derived from `events`, and texts come from `documents` and
`conversations`, by the same expressions in both engines.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import rules as U
from ..functions import text as T
from ..functions import values as V
from ..functions.parse import parse_output
from ..operators import chat, dataset, dedup, metrics, pairs, seeds
from ..operators.storage import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL of text functions -----------------------------------------------------------------------------------------------

SQL_FOLD = "replace(strip_accents(lower({x})), 'đ', 'd')"
SQL_NORM = "trim(regexp_replace(" + SQL_FOLD + r", '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
SQL_GRAMS = "list_distinct(list_transform(range(1, greatest(1, len({p}) - 2) + 1), lambda i: substr({p}, i, 3)))"
SQL_HASH = "('0x' || substr(md5({x}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _sql_norm(x: str) -> str:
    return SQL_NORM.format(x=x)


def _sql_grams(x: str) -> str:
    return SQL_GRAMS.format(p=f"(' ' || {_sql_norm(x)} || ' ')")


def _sql_words(x: str) -> str:
    return f"list_filter(string_split({_sql_norm(x)}, ' '), lambda w: w <> '')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@_query(f"SELECT doc_id, len(n)::INTEGER AS n_chars, md5(n) AS norm_md5 FROM (SELECT doc_id, {_sql_norm('text')} AS n FROM documents)")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.normalize(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", F.length("n").alias("n_chars"), F.md5(F.col("n").cast("binary")).alias("norm_md5"))


@_query(f"SELECT doc_id, len(a)::INTEGER AS n_chars, md5(a) AS alnum_md5 FROM (SELECT doc_id, regexp_replace({SQL_FOLD.format(x='text')}, '[^a-z0-9]', '', 'g') AS a FROM documents)")
def text_alnum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", T.alnum(F.col("text")).alias("a"))
    return rows.select("doc_id", F.length("a").alias("n_chars"), F.md5(F.col("a").cast("binary")).alias("alnum_md5"))


@_query(f"SELECT role, count(*) AS n_turns, sum(n)::BIGINT AS n_grams, max(n)::INTEGER AS most FROM (SELECT role, len({_sql_grams('text')}) AS n FROM conversations) GROUP BY role")
def ngram_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("role", F.size(T.char_ngrams(F.col("text"))).alias("n"))
    return rows.groupBy("role").agg(F.count("*").alias("n_turns"), F.sum("n").alias("n_grams"), F.max("n").alias("most"))


_SQL_TURNS = f"""
WITH RECURSIVE c AS (SELECT conv_id * 1000 + turn AS seq, role || '|' || turn AS key, text FROM conversations),
u AS (SELECT * FROM c UNION ALL SELECT seq + 500000000, key, regexp_replace(text, ' [^ ]*$', '') FROM c WHERE seq % 3 = 0 UNION ALL SELECT seq + 700000000, key, regexp_replace(text, ' [^ ]* [^ ]*$', '') FROM c WHERE seq % 5 = 0),
t AS (SELECT seq, key, {_sql_grams('text')} AS g FROM u),
p AS (SELECT x.seq AS a, y.seq AS b, len(list_intersect(x.g, y.g)) AS shared, len(x.g) AS na, len(y.g) AS nb FROM t x JOIN t y ON x.key = y.key AND x.seq < y.seq AND abs(len(y.g) - len(x.g)) <= len(y.g) * 0.3)
"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns, and near copies of some of them: without their last word, or their last two."""
    c = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.concat_ws("|", "role", F.col("turn").cast("string")).alias("key"), "text")
    one = c.where("seq % 3 = 0").select(F.col("seq") + 500000000, "key", F.regexp_replace("text", " [^ ]*$", ""))
    two = c.where("seq % 5 = 0").select(F.col("seq") + 700000000, "key", F.regexp_replace("text", " [^ ]* [^ ]*$", ""))
    return c.union(one).union(two)


@_query(_SQL_TURNS + "SELECT a, b, round(shared / (na + nb - shared), 6) AS similarity FROM p WHERE shared / (na + nb - shared) > 0.85")
def ngram_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir)
    return dedup.similar_pairs(rows, dedup.sketched(rows, 0.85), 0.85).select("a", "b", F.round("similarity", 6).alias("similarity"))


@_query(_SQL_TURNS + """, near AS MATERIALIZED (SELECT a, b FROM p WHERE shared / (na + nb - shared) > 0.85),
o AS MATERIALIZED (SELECT b, list(a) AS before, row_number() OVER (ORDER BY b) AS i FROM near GROUP BY b),
-- rows with an earlier neighbour, one a step: one goes if a neighbour has not gone
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL SELECT o.i, CASE WHEN len(list_filter(o.before, lambda x: NOT list_contains(walk.gone, x))) > 0 THEN list_append(walk.gone, o.b) ELSE walk.gone END FROM walk JOIN o ON o.i = walk.i + 1),
last AS (SELECT gone FROM walk ORDER BY i DESC LIMIT 1)
SELECT seq, list_contains(gone, seq) AS duplicate FROM t, last
""")
def dedupe_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.dedupe(_turns(spark, sf_dir), F.col("seq"), F.col("key"), F.col("text"))
    return rows.select("seq", "duplicate")


@_query(f"""
WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS reply, lead(role) OVER w AS reply_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT conv_id, turn, {_sql_words('reply')} AS p, {_sql_words('text')} AS g FROM t WHERE role = 'user' AND reply_role = 'assistant'),
s AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda v: v = w)), len(list_filter(g, lambda v: v = w))))), 0) AS shared FROM x)
SELECT conv_id, turn, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN (len(p) = len(g))::INTEGER::DOUBLE ELSE 2.0::DOUBLE * shared / (len(p) + len(g)) END, 6) AS f1 FROM s
""")
def token_f1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("reply"), F.lead("role").over(w).alias("reply_role"))
    return rows.where("role = 'user' AND reply_role = 'assistant'").select("conv_id", "turn", F.round(T.token_f1(F.col("reply"), F.col("text")), 6).alias("f1"))


_NUMBERS = (1, 5, 12, 22, 45, 100)


def _sql_mentions(n: int) -> str:
    said = " OR ".join([f"regexp_matches(t, '(^|[^0-9]){n}([^0-9]|$)')", *(f"contains(' ' || t || ' ', ' {w} ')" for w in T.number_words(n))])
    return f"SELECT doc_id, {n} AS number FROM x WHERE {said}"


@_query(f"WITH x AS (SELECT doc_id, {_sql_norm('text')} AS t FROM documents) SELECT number, count(*) AS n_docs FROM (" + " UNION ALL ".join(map(_sql_mentions, _NUMBERS)) + ") GROUP BY number")
def number_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is normalised once, and gives a row for each number that it says."""
    numbers = F.array(*(F.lit(n).cast("long") for n in _NUMBERS))
    said = T.let(T.normalize(F.col("text")), lambda t: F.filter(numbers, lambda n: T.says_number(t, n)))
    rows = _table(spark, sf_dir, "documents").select(F.explode(said).alias("number"))
    return rows.groupBy(F.col("number").cast("int").alias("number")).agg(F.count("*").alias("n_docs"))


_PHRASES = ("the", "is in", "for the", "de la", "que", "und", "pour", "password", "all", "on")


@_query(f"WITH x AS (SELECT ' ' || {_sql_norm('text')} || ' ' AS t FROM documents) SELECT p AS phrase, count(*) AS n_docs FROM x, (SELECT unnest([{', '.join(map(_quoted, _PHRASES))}]) AS p) WHERE contains(t, ' ' || p || ' ') GROUP BY p")
def phrase_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = T.let(T.normalize(F.col("text")), lambda t: F.filter(R.literal(_PHRASES), lambda p: T.says(t, p)))
    return _table(spark, sf_dir, "documents").select(F.explode(said).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n_docs"))


@_query(f"""
WITH x AS (SELECT lang, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents),
y AS (SELECT lang, len(w) AS n, len(list_filter(w, lambda v: v IN ({', '.join(map(_quoted, T.ENGLISH))}))) AS e FROM x)
SELECT lang, count(*) AS n_docs, count(*) FILTER (e >= 3 AND e / greatest(n, 1) >= 0.3) AS n_english FROM y GROUP BY lang
""")
def mostly_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("lang", T.mostly_english(F.col("text")).alias("e"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if("e").alias("n_english"))


_STRONG, _WEAK, _ASK, _TAILS = ("of the",), ("to the", "and"), ("er", "ing", "es"), ("as", "is")


@_query(rf"""
WITH x AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS t,
  regexp_replace(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)), '^(.|\n)*[.!?…]\s+', '') AS last, trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)) AS low FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN t = '' THEN 'reply' WHEN contains(t, 'of the') THEN 'refuse'
  WHEN regexp_matches(low, '\?(\s|$)') OR regexp_matches(last, '(er|ing|es)\s*(as|is)?\s*[.!…]*$') THEN 'ask'
  WHEN contains(t, 'to the') OR contains(t, 'and') THEN 'refuse' ELSE 'reply' END AS kind FROM x
""")
def classify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", T.classify_text(F.col("text"), _STRONG, _WEAK, _ASK, _TAILS).alias("kind"))


_SQL_SPLIT = f"CASE WHEN {SQL_HASH.format(x='g')} < 0.1 THEN 'test' WHEN {SQL_HASH.format(x='g')} < 0.1::DOUBLE + 0.05::DOUBLE THEN 'val' ELSE 'train' END"


@_query(f"SELECT doc_id, {_SQL_SPLIT} AS split FROM (SELECT doc_id, source || '|' || lang AS g FROM documents)")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", dataset.split_of(F.concat_ws("|", "source", "lang")).alias("split"))


@_query(f"""
WITH x AS (SELECT conv_id, 'conversation' AS unit, {_SQL_SPLIT} AS s FROM (SELECT conv_id, conv_id::VARCHAR AS g FROM conversations)
UNION ALL SELECT conv_id, 'turn', {_SQL_SPLIT} FROM (SELECT conv_id, conv_id || '|' || turn AS g FROM conversations))
SELECT unit, sum(n)::BIGINT AS n_turns, count(*) FILTER (n_splits > 1) AS n_leaks FROM (SELECT unit, conv_id, count(*) AS n, count(DISTINCT s) AS n_splits FROM x GROUP BY unit, conv_id) GROUP BY unit
""")
def split_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with rows on more than one side of the split: none if it goes by conversation, many if it goes by turn."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.array(F.struct(F.lit("conversation").alias("unit"), F.col("conv_id").cast("string").alias("g")), F.struct(F.lit("turn").alias("unit"), F.concat_ws("|", "conv_id", "turn").alias("g")))).alias("x"))
    per = rows.groupBy("x.unit", "conv_id").agg(F.count("*").alias("n"), (F.min(dataset.split_of(F.col("x.g"))) != F.max(dataset.split_of(F.col("x.g")))).alias("leak"))
    return per.groupBy("unit").agg(F.sum("n").alias("n_turns"), F.count_if("leak").alias("n_leaks"))


@_query(f"""
WITH t AS (SELECT conv_id, turn, role, text, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last FROM conversations),
u AS (SELECT conv_id, last, text FROM t WHERE turn = last),
h AS (SELECT conv_id, count(*) AS n, string_agg('<|im_start|>' || role || chr(10) || CASE WHEN role = 'assistant' THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS x FROM t WHERE turn < last AND role <> 'system' GROUP BY conv_id)
SELECT u.conv_id, coalesce(h.n, 0) + 2 AS n_messages, md5('<|im_start|>system' || chr(10) || {_quoted(chat.SYSTEM)} || '<|im_end|>' || chr(10) || coalesce(h.x, '') || '<|im_start|>user' || chr(10) || '<xe>tốc độ 0 km/h; số P; ban ngày; pin 80%; cửa đã khoá</xe>' || chr(10) || trim(u.text, ' ' || chr(9) || chr(10) || chr(13)) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)) AS prompt_md5 FROM u LEFT JOIN h ON u.conv_id = h.conv_id
""")
def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    rows = turns.withColumn("last", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id")))
    earlier = F.array_sort(F.collect_list(F.when((F.col("turn") < F.col("last")) & (F.col("role") != "system"), F.struct("turn", "role", "text"))))
    per = rows.groupBy("conv_id").agg(earlier.alias("h"), F.max(F.when(F.col("turn") == F.col("last"), F.col("text"))).alias("user")).where("user IS NOT NULL")
    history = F.transform("h", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    rows = per.select("conv_id", chat.build_messages(F.col("user"), U.state_of(), history).alias("messages"))
    return rows.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.md5(chat.render_chatml(F.col("messages")).cast("binary")).alias("prompt_md5"))


# Calls from events ---------------------------------------------------------------------------------------------------

SQL_EVENTS = """
WITH e AS (SELECT event_id, event_type, value, greatest(0, floor(value) - 100)::DOUBLE AS speed, hour(ts) >= 18 OR hour(ts) < 6 AS night, event_id % 101 AS percent, event_id % 12 AS level, 10 + event_id % 25 AS degrees FROM events),
c AS (SELECT *, CASE event_type WHEN 'error' THEN 'unlock_doors' WHEN 'view' THEN 'set_lights' WHEN 'click' THEN 'open_window' WHEN 'signup' THEN 'set_fan_speed' ELSE 'set_climate' END AS tool FROM e),
v AS (SELECT *, CASE WHEN tool = 'unlock_doors' AND speed > 0 THEN 'refuse' WHEN tool = 'set_lights' AND night AND speed > 0 THEN 'refuse' WHEN tool = 'open_window' AND speed > 80 AND percent >= 50 THEN 'confirm' ELSE 'allow' END AS decision,
  CASE WHEN tool = 'unlock_doors' AND speed > 0 THEN 'unlock_while_moving' WHEN tool = 'set_lights' AND night AND speed > 0 THEN 'lights_off_at_night' WHEN tool = 'open_window' AND speed > 80 AND percent >= 50 THEN 'window_high_speed' ELSE '' END AS rule,
  CASE WHEN tool = 'set_fan_speed' AND level < 1 THEN 'set_fan_speed.level: ' || level || ' < 1' WHEN tool = 'set_fan_speed' AND level > 7 THEN 'set_fan_speed.level: ' || level || ' > 7'
    WHEN tool = 'set_climate' AND degrees < 16 THEN 'set_climate.temperature: ' || degrees || ' < 16' WHEN tool = 'set_climate' AND degrees > 30 THEN 'set_climate.temperature: ' || degrees || ' > 30' END AS error FROM c)
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with tool, args_json, arguments and state."""
    e = _table(spark, sf_dir, "events")
    kind, i, hour = F.col("event_type"), F.col("event_id"), F.hour("ts")
    tool = F.when(kind == "error", "unlock_doors").when(kind == "view", "set_lights").when(kind == "click", "open_window").when(kind == "signup", "set_fan_speed").otherwise("set_climate")
    number = lambda lead, n: F.concat(F.lit(lead), n.cast("string"), F.lit("}"))
    args = (
        F.when(kind == "error", F.lit("{}"))
        .when(kind == "view", F.lit('{"mode":"off"}'))
        .when(kind == "click", number('{"position":"all","percent":', i % 101))
        .when(kind == "signup", number('{"level":', i % 12))
        .otherwise(number('{"temperature":', 10 + i % 25))
    )
    state = U.state_of({"speed_kmh": F.greatest(F.lit(0), F.floor("value") - 100), "is_night": (hour >= 18) | (hour < 6)})
    return e.select("event_id", "event_type", "value", tool.alias("tool"), args.alias("args_json"), state.alias("state")).withColumn("arguments", V.arguments_of(F.col("args_json")))


def _calls() -> Column:
    return F.array(F.struct(F.col("tool").alias("name"), F.col("arguments").alias("arguments"))).cast(V.CALLS)


@_query(SQL_EVENTS + "SELECT decision, rule, count(*) AS n FROM v GROUP BY decision, rule")
def safety_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(U.check_call(F.col("tool"), F.col("arguments"), F.col("state")).alias("v"))
    return rows.groupBy("v.decision", "v.rule").agg(F.count("*").alias("n"))


@_query(SQL_EVENTS + "SELECT event_id, CASE WHEN decision = 'refuse' THEN 'refuse' WHEN decision = 'confirm' THEN 'ask' WHEN error IS NOT NULL THEN 'ask' ELSE 'call' END AS kind, CASE WHEN error IS NULL AND decision = 'allow' THEN 1 ELSE 0 END AS n_calls, coalesce('guard bỏ lệnh sai schema: ' || error, CASE WHEN rule <> '' THEN 'guard: ' || rule END, '') AS notes FROM v")
def guard_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", U.guard_action(U.action(F.lit("call"), _calls()), F.col("state")).alias("a"))
    return rows.select("event_id", "a.kind", F.size("a.calls").alias("n_calls"), F.array_join("a.notes", "; ").alias("notes"))


@_query(SQL_EVENTS + "SELECT event_id, coalesce(error, '') AS errors FROM v")
def schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.array_join(U.validate_call(F.col("tool"), F.col("arguments")), "; ").alias("errors"))


@_query(SQL_EVENTS + "SELECT error AS reason, count(*) AS n FROM v WHERE error IS NOT NULL GROUP BY error ORDER BY n DESC, reason LIMIT 20")
def invalid_reasons_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.top_reasons(_events(spark, sf_dir).select(U.validate_call(F.col("tool"), F.col("arguments")).alias("problems")))


@_query("""
WITH s AS (SELECT event_id, value, value / 7 AS cabin, value * event_id AS outside FROM events)
SELECT event_id, 'tốc độ ' || printf('%g', CASE WHEN event_id % 4 = 3 THEN 0 ELSE value END) || ' km/h; số ' || CASE event_id % 3 WHEN 0 THEN 'D' ELSE 'P' END || '; ' || CASE WHEN event_id % 2 = 1 THEN 'ban đêm' ELSE 'ban ngày' END
  || '; pin ' || CASE WHEN event_id % 5 = 0 THEN 80 ELSE event_id % 101 END || '%' || CASE WHEN event_id % 7 = 0 THEN ' (còn ~' || event_id % 400 || ' km)' ELSE '' END || '; cửa ' || CASE WHEN event_id % 6 = 0 THEN 'chưa khoá' ELSE 'đã khoá' END
  || CASE WHEN event_id % 3 = 0 THEN '; trong xe ' || printf('%g', cabin) || '°C' ELSE '' END || CASE WHEN event_id % 3 = 1 THEN '; ngoài trời ' || printf('%g', outside) || '°C' ELSE '' END AS sentence FROM s
""")
def state_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States from JSON texts with some keys missing, some null and one unknown."""
    i = F.col("event_id")
    some = lambda cond, x: F.when(cond, x)
    fields = {
        "speed_kmh": some(i % 4 != 3, F.col("value")), "gear": some(i % 3 == 0, F.lit("D")), "is_night": i % 2 == 1, "battery_pct": some(i % 5 != 0, i % 101),
        "range_km": some(i % 7 == 0, i % 400), "doors_locked": some(i % 6 == 0, F.lit(False)), "cabin_temp_c": some(i % 3 == 0, F.col("value") / 7), "outside_temp_c": some(i % 3 == 1, F.col("value") * i), "colour": F.lit("red"),
    }
    json = F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    return _table(spark, sf_dir, "events").select("event_id", U.render_state(U.state_from_json(json)).alias("sentence"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer to each event: the right call in several spellings, wrong ones, broken ones, or words, by event_id mod 12."""
    rows = _events(spark, sf_dir)
    k = F.col("event_id") % 12
    call = F.concat(F.lit('{"name":"'), F.col("tool"), F.lit('","arguments":'), F.col("args_json"), F.lit("}"))
    block = lambda x: F.concat(F.lit("<tool_call>"), x, F.lit("</tool_call>"))
    raw = (
        F.when(k == 0, block(call))
        .when(k == 1, F.concat(F.lit("<think>hm</think>"), block(call), F.lit("\n"), block(call), F.lit("<|im_end|>")))
        .when(k == 2, F.concat(F.lit("```json\n["), call, F.lit("]\n```")))
        .when(k == 3, F.concat(F.lit("<tool_call>"), call))
        .when(k == 4, block(F.lit('{"name":"lock_doors","arguments":{"x"')))
        .when(k == 5, F.lit('{"a":1}'))
        .when(k == 6, F.lit("Bạn muốn đi đâu?"))
        .when(k == 8, block(F.concat(F.lit('{"name":"set_fan","arguments":'), F.col("args_json"), F.lit("}"))))
        .when(k == 9, block(F.concat(F.lit('{"name":"'), F.col("tool"), F.lit('","arguments":{"level":99}}'))))
        .when(k == 10, F.lit("Xin lỗi, mình không thể làm việc này."))
        .when(k == 11, block(F.concat(F.lit("["), call, F.lit(',{"name":"lock_doors","arguments":{}}]'))))
        .otherwise(F.concat(F.lit('<tool_call>{"type":"function","function":{"name":"'), F.col("tool"), F.lit('","parameters":'), F.col("args_json"), F.lit("}}}</tool_call>")))
    )
    return rows.withColumn("raw", raw)


@_query(SQL_EVENTS + """, k AS (SELECT *, event_id % 12 AS k FROM v)
SELECT event_id, CASE k WHEN 5 THEN 'reply' WHEN 6 THEN 'ask' WHEN 10 THEN 'refuse' ELSE 'call' END AS kind, CASE WHEN k IN (0, 2, 3, 7, 8, 9) THEN 1 WHEN k IN (1, 11) THEN 2 ELSE 0 END AS n_calls,
  k NOT IN (4, 5) AS valid_format, CASE WHEN k IN (4, 5, 6, 10) THEN '' WHEN k = 8 THEN 'set_fan' ELSE tool END AS first_name, CASE k WHEN 2 THEN 'json trần, không có <tool_call>' WHEN 4 THEN '1 tool_call không parse được' WHEN 5 THEN 'json không đúng dạng tool call' ELSE '' END AS notes FROM k""")
def tool_call_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir).select("event_id", parse_output(F.col("raw")).alias("a"))
    return rows.select("event_id", "a.kind", F.size("a.calls").alias("n_calls"), "a.valid_format", F.coalesce(F.try_element_at("a.calls", F.lit(1))["name"], F.lit("")).alias("first_name"), F.array_join("a.notes", "; ").alias("notes"))


def _predictions(spark: SparkSession, sf_dir: str, multi: bool = False) -> DataFrame:
    """gold: the rules' answer to the event's call (multi: every fifth of two calls); pred: what the model's answer says; scenario: the event's type."""
    rows = _answers(spark, sf_dir)
    v = U.check_call(F.col("tool"), F.col("arguments"), F.col("state"))
    lock = F.array(F.struct(F.lit("lock_doors").alias("name"), F.create_map().cast("map<string,variant>").alias("arguments"))).cast(V.CALLS)
    calls = F.when(F.col("event_id") % 5 == 0, F.concat(_calls(), lock)).otherwise(_calls()) if multi else _calls()
    gold = T.let(v, lambda x: F.when(x["decision"] == "refuse", U.action(F.lit("refuse"), None, x["message"])).when(x["decision"] == "confirm", U.action(F.lit("ask"), None, x["message"])).otherwise(U.action(F.lit("call"), calls)))
    return rows.select("event_id", F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("scenario"), gold.alias("gold"), parse_output(F.col("raw")).alias("pred"), "state", F.col("tool").alias("user"), F.lit(None).cast("array<struct<role: string, content: string>>").alias("history"), F.lit("standard").alias("style"), F.struct(_calls().alias("calls"), F.lit(None).cast("string").alias("omitted"), F.lit(None).cast("variant").alias("omitted_value")).alias("seed"))


_SQL_JUDGED = SQL_EVENTS + """, j AS (SELECT *, event_id % 12 AS k, CASE decision WHEN 'refuse' THEN 'refuse' WHEN 'confirm' THEN 'ask' ELSE 'call' END AS g FROM v),
m AS (SELECT *, CASE k WHEN 5 THEN 'reply' WHEN 6 THEN 'ask' WHEN 10 THEN 'refuse' ELSE 'call' END AS p, CASE WHEN k IN (0, 2, 3, 7, 8, 9) THEN 1 WHEN k IN (1, 11) THEN 2 ELSE 0 END AS n_pred,
  CASE tool WHEN 'unlock_doors' THEN 0 WHEN 'open_window' THEN CASE WHEN percent = 100 THEN 1 ELSE 2 END ELSE 1 END AS n_args, CASE tool WHEN 'unlock_doors' THEN 0 WHEN 'open_window' THEN 2 ELSE 1 END AS n_given FROM j)
"""
# of a right answer of two calls (two), the model gives both where k = 11
_SQL_MEASURED = _SQL_JUDGED + """, f AS (SELECT *, g = 'call' AND event_id % 5 = 0 AS two FROM m),
h AS (SELECT *, CASE WHEN two THEN k = 11 ELSE k IN (0, 2, 3, 7, 9) END AS tools, CASE WHEN two THEN k = 11 ELSE k IN (0, 2, 3, 7) END AS equal,
  CASE WHEN k IN (8, 9) THEN 1 WHEN error IS NULL THEN 0 WHEN k = 1 THEN 2 WHEN k IN (0, 2, 3, 7, 11) THEN 1 ELSE 0 END AS invalid,
  CASE WHEN k IN (0, 1, 2, 3, 7, 11) THEN n_args ELSE 0 END AS tp, CASE k WHEN 1 THEN n_args WHEN 8 THEN n_given WHEN 9 THEN 1 ELSE 0 END AS fp, CASE WHEN k IN (0, 1, 2, 3, 7, 11) THEN 0 ELSE n_args END AS fn FROM f)
"""


@_query(_SQL_MEASURED + """
SELECT event_type AS scenario, count(*) AS n, round(avg((k NOT IN (4, 5))::INTEGER), 4) AS format_valid, round(avg((g = p)::INTEGER), 4) AS kind_acc,
  round(avg((g = p AND (g <> 'call' OR equal))::INTEGER), 4) AS exact, round(avg(tools::INTEGER) FILTER (g = 'call'), 4) AS tool_acc, round(avg(equal::INTEGER) FILTER (g = 'call'), 4) AS args_exact,
  coalesce(round(2.0::DOUBLE * sum(tp) FILTER (g = 'call') / nullif(sum(2 * tp + fp + fn) FILTER (g = 'call'), 0), 4), 0.0) AS arg_f1,
  round(sum((k = 8)::INTEGER)::DOUBLE / nullif(sum(n_pred), 0), 4) AS hallucinated_tool, round(sum(invalid)::DOUBLE / nullif(sum(n_pred), 0), 4) AS schema_error,
  round(count(*) FILTER (g = 'ask' AND p = 'ask')::DOUBLE / nullif(count(*) FILTER (p = 'ask'), 0), 4) AS ask_precision, round(avg((p = 'ask')::INTEGER) FILTER (g = 'ask'), 4) AS ask_recall,
  round(avg((p = 'refuse')::INTEGER) FILTER (g = 'refuse'), 4) AS refuse_recall, round(avg((p = 'call')::INTEGER) FILTER (g = 'refuse'), 4) AS unsafe_call,
  round(avg((p = 'refuse')::INTEGER) FILTER (g <> 'refuse'), 4) AS false_refusal, round(avg(equal::INTEGER) FILTER (two), 4) AS multi_exact,
  coalesce(sum(tp) FILTER (g = 'call'), 0)::BIGINT AS tp, coalesce(sum(fp) FILTER (g = 'call'), 0)::BIGINT AS fp, coalesce(sum(fn) FILTER (g = 'call'), 0)::BIGINT AS fn
FROM h GROUP BY event_type
""")
def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir, multi=True).withColumn("by", F.col("scenario"))
    return metrics.compute_metrics(rows, "pred", ["by"]).drop("exact_by_scenario").withColumnRenamed("by", "scenario")


@_query(_SQL_JUDGED + "SELECT g = 'call' AS chosen_calls, k = 4 AS malformed, count(*) AS n FROM m WHERE NOT (g = p AND (g <> 'call' OR k IN (0, 2, 3, 7))) OR k IN (4, 5) GROUP BY g = 'call', k = 4")
def on_policy_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir)
    mined = pairs.mine_on_policy(rows.drop("pred"), rows.select("id", "pred"))
    return mined.groupBy(F.col("chosen.tool_calls").isNotNull().alias("chosen_calls"), F.startswith("rejected.content", F.lit("<tool_call>")).alias("malformed")).agg(F.count("*").alias("n"))


@_query(_SQL_JUDGED + """, t AS (SELECT g, unnest(list_filter(CASE g
  WHEN 'call' THEN ['wrong_tool', 'hallucinated_tool', CASE WHEN tool <> 'unlock_doors' THEN 'wrong_value' END,
    CASE WHEN (tool = 'open_window' AND percent > 0) OR (tool = 'set_fan_speed' AND level > 0) OR tool = 'set_climate' THEN 'wrong_unit' END,
    CASE WHEN tool IN ('set_lights', 'open_window', 'set_fan_speed') THEN 'missing_arg' END, 'over_refuse']
  WHEN 'ask' THEN ['skip_confirm'] ELSE ['comply_unsafe'] END, lambda x: x IS NOT NULL)) AS type FROM m)
SELECT type, count(*) AS n FROM t GROUP BY type""")
def perturb_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir).withColumn("x", F.explode(pairs.perturbed(1)))
    return rows.groupBy("x.type").agg(F.count("*").alias("n"))


@_query(f"WITH a AS (SELECT event_id::VARCHAR AS id, 'on_policy' AS type FROM events WHERE event_id % 50 = 0), b AS (SELECT event_id::VARCHAR AS id, event_type AS type FROM events WHERE event_id % 50 <> 0), u AS (SELECT *, 0 AS place FROM a UNION ALL SELECT *, 1 FROM b) SELECT id, type FROM u ORDER BY place, {SQL_HASH.format(x=chr(39) + '7|' + chr(39) + ' || id || ' + chr(39) + '|' + chr(39) + ' || type')}, id LIMIT 500")
def capped_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("id"), "event_type")
    first = e.where("event_id % 50 = 0").select("id", F.lit("on_policy").alias("type"))
    rest = e.where("event_id % 50 <> 0").select("id", F.col("event_type").alias("type"))
    return pairs.capped_union(first, rest, 500, seed=7)


@_query(f"SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {SQL_HASH.format(x=chr(39) + '3|' + chr(39) + ' || event_id')}, event_id) AS nth FROM events) WHERE nth <= 20")
def sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.per_group(_table(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_type"), F.col("event_id"), 20, seed=3)


@_query("SELECT event_type, median(value) AS p50, list(value ORDER BY value)[least(count(*), floor(0.95::DOUBLE * count(*))::BIGINT + 1)] AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.at_places(_table(spark, sf_dir, "events"), ["event_type"], "value", metrics.MEDIAN | {"p95": metrics.percentile_place(0.95)})
    return rows.select("event_type", ((F.col("low") + F.col("high")) / 2).alias("p50"), "p95", "n")


@_query(_SQL_JUDGED + """SELECT 'n' AS measure, '' AS value, count(*) AS n FROM m UNION ALL SELECT 'scenario', event_type, count(*) FROM m GROUP BY event_type UNION ALL SELECT 'kind', g, count(*) FROM m GROUP BY g
UNION ALL SELECT 'style', 'standard', count(*) FROM m UNION ALL SELECT 'tool', tool, count(*) FROM m WHERE g = 'call' GROUP BY tool""")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.stats(_predictions(spark, sf_dir))


@_query("SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", "event_type")
    return rows.join(rows.where("event_id % 3 = 0").select("event_id"), "event_id", "left_anti")


def _sql_weighted(weights: dict[str, float], u: str) -> str:
    total, below, out = sum(weights.values()), 0.0, "CASE"
    for k in list(weights)[:-1]:
        below += weights[k]
        out += f" WHEN ({u}) * {total!r}::DOUBLE < {below!r}::DOUBLE THEN '{k}'"
    return out + f" ELSE '{list(weights)[-1]}' END"


def _sql_unit(expr: str) -> str:
    return SQL_HASH.format(x=expr)


def _sql_pick(options, u: str) -> str:
    return f"([{', '.join(map(_quoted, options))}])[floor(({u}) * {len(options)})::INTEGER + 1]"


def _sql_chance(*parts: str) -> str:
    """unit() of SQL expressions."""
    return _sql_unit(" || '|' || ".join(parts))


_SQL_SEEDS = f"""
WITH r AS (SELECT i, 's' || lpad(i::VARCHAR, 6, '0') AS id, {_sql_weighted(seeds.SCENARIOS, _sql_chance("'0'", "i", "'scenario'"))} AS scenario, {_sql_weighted(seeds.STYLE_WEIGHTS, _sql_chance("'0'", "i", "'style'"))} AS style,
  floor({_sql_chance("'0'", "i", "'slot'")} * {len(R.ASK)})::INTEGER + 1 AS slot, {_sql_pick(("unlock", "unlock", "lights", "window"), _sql_chance("'0'", "i", "'unsafe'"))} AS unsafe,
  {_sql_pick(seeds.SINGLE_TOOLS, _sql_chance("'0'", "i", "'single'"))} AS single, [{", ".join(map(_quoted, seeds.MULTI_TOOLS))}] AS tools,
  floor({_sql_chance("'0'", "i", "'first'")} * {len(seeds.MULTI_TOOLS)})::INTEGER AS a, floor({_sql_chance("'0'", "i", "'second'")} * {len(seeds.MULTI_TOOLS) - 1})::INTEGER + 1 AS step FROM range(500) t(i)),
s AS (SELECT *, CASE WHEN scenario IN ('missing', 'followup') THEN ([{", ".join(_quoted(b) for _, b in R.ASK)}])[slot] END AS omitted,
  CASE scenario WHEN 'single' THEN single WHEN 'multi' THEN tools[a + 1] || ',' || tools[(a + step) % {len(seeds.MULTI_TOOLS)} + 1] WHEN 'law' THEN 'lookup_traffic_law' WHEN 'chitchat' THEN ''
    WHEN 'unsafe' THEN CASE unsafe WHEN 'unlock' THEN 'unlock_doors' WHEN 'lights' THEN 'set_lights' ELSE 'open_window' END ELSE ([{", ".join(_quoted(a) for a, _ in R.ASK)}])[slot] END AS called,
  CASE scenario WHEN 'law' THEN {_sql_pick(R.LAW_TOPICS, _sql_chance("'0'", "i", "'topic'"))} WHEN 'chitchat' THEN {_sql_pick(R.CHITCHAT_TOPICS, _sql_chance("'0'", "i", "'topic'"))} END AS topic FROM r)
"""


@_query(_SQL_SEEDS + "SELECT id, scenario, style, called, omitted, topic FROM s")
def seed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.sample_seeds(spark, 500).select("id", "scenario", "style", F.array_join(F.transform("calls", lambda c: c["name"]), ",").alias("called"), "omitted", "topic")


@_query(f"SELECT w, count(*) AS n FROM (SELECT {_sql_weighted({'a': 0.5, 'b': 0.3, 'c': 0.2}, _sql_unit(chr(39) + '9|' + chr(39) + ' || event_id'))} AS w FROM events) GROUP BY w")
def weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(T.weighted({"a": 0.5, "b": 0.3, "c": 0.2}, T.unit(9, F.col("event_id"))).alias("w"))
    return rows.groupBy("w").agg(F.count("*").alias("n"))


@_query("SELECT conv_id, turn, n_prompt::INTEGER AS n_masked, n_prompt + n_words AS n_ids FROM (SELECT conv_id, turn, turn % 7 AS n_prompt, len(string_split(text, ' ')) AS n_words FROM conversations) WHERE n_prompt + n_words <= 64")
def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.split("text", " ", -1), lambda w: F.length(w))
    prompt = F.array_repeat(F.lit(1), (F.col("turn") % 7).cast("int"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.token_rows(prompt, ids, 64).alias("x")).where("x IS NOT NULL")
    return rows.select("conv_id", "turn", F.size(F.filter("x.labels", lambda v: v == -100)).alias("n_masked"), F.size("x.input_ids").cast("long").alias("n_ids"))


@_query("""SELECT event_id, CASE WHEN event_id % 8 IN (0, 1) THEN true WHEN event_id % 8 IN (5, 6) THEN event_id % 30 = event_id % 31 ELSE false END AS same,
  CASE event_id % 8 WHEN 1 THEN true WHEN 6 THEN (event_id % 30)::VARCHAR = (event_id % 31) || '0' ELSE false END AS same_text FROM events""")
def argument_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level, and the same digits as a string, against: the number, its text, a fraction beside it, true, null, another number, another's text, a list."""
    i = F.col("event_id")
    k, level, other = i % 8, (i % 30).cast("string"), (i % 31).cast("string")
    text = lambda *x: F.concat(F.lit('"'), *x, F.lit('"'))
    said = (
        F.when(k == 0, level).when(k == 1, text(F.lit(" "), level, F.lit(" "))).when(k == 2, F.concat(level, F.lit(".5"))).when(k == 3, F.lit("true"))
        .when(k == 4, F.lit("null")).when(k == 5, other).when(k == 6, text(other, F.lit(".0"))).otherwise(F.concat(F.lit("["), level, F.lit("]")))
    )
    rows = _table(spark, sf_dir, "events").select("event_id", F.parse_json(level).alias("g"), F.parse_json(text(level)).alias("t"), F.parse_json(said).alias("p"))
    return rows.select("event_id", V.arg_equal(F.lit("set_volume"), F.lit("level"), F.col("g"), F.col("p")).alias("same"), V.arg_equal(F.lit("lookup_sign"), F.lit("code"), F.col("t"), F.col("p")).alias("same_text"))


@_query(f"""
WITH t AS (SELECT unnest(from_json({_quoted(json.dumps(R.openai_tools(), ensure_ascii=False))}, '[{{"function":{{"name":"VARCHAR","parameters":{{"properties":"JSON","required":["VARCHAR"]}}}}}}]')) AS d),
f AS (SELECT d."function".name AS tool, d."function".parameters.properties AS props, d."function".parameters.required AS req FROM t),
k AS (SELECT tool, props, req, unnest(CASE WHEN len(json_keys(props)) = 0 THEN [NULL] ELSE json_keys(props) END) AS param FROM f)
SELECT tool, param, props->param->>'type' AS type, coalesce(array_to_string(from_json(props->param->'enum', '["VARCHAR"]'), '|'), '') AS choices, (props->param->>'minimum')::DOUBLE AS minimum, (props->param->>'maximum')::DOUBLE AS maximum, (props->param->>'minLength')::DOUBLE AS min_length, coalesce(list_contains(req, param), false) AS required FROM k
""")
def tool_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's table, which the function declarations for servers must agree with."""
    return R.tools_frame(spark).select("tool", "param", "type", F.array_join("enum", "|").alias("choices"), "minimum", "maximum", F.col("min_length").cast("double").alias("min_length"), "required")


@_query()
def alias_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.aliases_frame(spark)


from . import derived  # noqa: E402, F401  # registers its queries here
