import json
import os
import pathlib
import random
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from callweave.functions import parse as P
from callweave.functions import rules as U
from callweave.operators import chat, dataset, dedup, metrics, pairs, seeds, storage
from callweave.operators.predict import Scripted, predict
from callweave.operators.storage import stored
from callweave.sources import files, writer
from callweave.streaming.guard import append_once, guarded


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests


def grams(s):
    p = f" {' '.join(s.lower().split())} "
    return frozenset(p[i : i + 3] for i in range(max(1, len(p) - 2)))


def greedy(rows, threshold):
    kept, gone = {}, set()
    for seq, key, text in sorted(rows):
        g = grams(text)
        if any(abs(len(g) - len(o)) <= len(g) * 0.3 and len(g & o) / len(g | o) > threshold for o in kept.setdefault(key, [])):
            gone.add(seq)
        else:
            kept[key].append(g)
    return gone


@pytest.mark.parametrize("threshold", [0.5, 0.85])
def test_dedup_is_the_greedy_one(spark, threshold):
    rng = random.Random(3)
    base = [" ".join(rng.choice("mo cua so nhac den xe lai dieu hoa bat tat".split()) for _ in range(rng.randint(2, 9))) for _ in range(25)]
    rows = []
    for i in range(160):
        words = rng.choice(base).split()
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = rng.choice(["x", "yy", "cua"])
        rows.append((i, rng.choice("ab"), " ".join(words)))
    rows += [(1000 + i, "a", "bat dieu hoa len") for i in range(40)]
    got = dedup.dedupe(spark.createDataFrame(rows, "seq int, key string, text string"), F.col("seq"), F.col("key"), F.col("text"), threshold)
    assert {r.seq for r in got.where("duplicate").collect()} == greedy(rows, threshold)
    assert got.count() == len(rows)


def syllables(rng, n):
    return "".join(rng.choice(("the", "on ", "er", "ing ", "an", "re ", "th", "ea", "st ", "ble", "of ", "ti", "ha", "ou ")) for _ in range(n))


@pytest.mark.parametrize("threshold", [0.5, 0.85])
def test_dedup_in_tiles_is_the_greedy_one(spark, threshold, monkeypatch):
    monkeypatch.setattr(dedup, "ROWS", 20)
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), syllables(rng, rng.choice((3, 20, 60, 150)))) for i in range(150)]
    rows += [(1000 + i, key, text.rsplit(" ", rng.randint(1, 3))[0]) for i, key, text in rows[::2]]
    rows += [(2000, None, "mo cua so"), (2001, None, "mo cua so"), (2002, "a", None), (2003, "a", None), (2004, "a", ""), (2005, "a", " ")]
    got = dedup.dedupe(spark.createDataFrame(rows, "seq int, key string, text string"), F.col("seq"), F.col("key"), F.col("text"), threshold)
    assert {r.seq for r in got.where("duplicate").collect()} == greedy([r for r in rows if None not in r], threshold)


def test_dedup_of_texts_of_the_same_ngrams_keeps_little(spark):
    """Most texts share most n-grams: what is stored is less than the texts, and few pairs go to the sets."""
    rng = random.Random(9)
    texts = [syllables(rng, rng.randint(100, 200)) for _ in range(1000)]
    rows = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "seq int, key string, text string").repartition(2)
    folder = storage.folder(spark).removeprefix("file://")
    size = lambda: sum(p.stat().st_size for p in pathlib.Path(folder).rglob("*.parquet")) if os.path.isdir(folder) else 0
    with storage.scope(spark):
        before = size()
        got = dedup.dedupe(rows, F.col("seq"), F.col("key"), F.col("text")).where("duplicate").count()
        assert got == 0 and size() - before < sum(map(len, texts)) / 2


def test_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], "seq int, key string, text string")
    assert dedup.dedupe(empty, F.col("seq"), F.col("key"), F.col("text")).count() == 0


def test_split_is_stable_and_by_group(spark):
    rows = spark.range(500).select(F.concat(F.lit("g"), (F.col("id") % 50).cast("string")).alias("g"), "id")
    one = rows.withColumn("s", dataset.split_of(F.col("g")))
    two = rows.orderBy(F.desc("id")).withColumn("s", dataset.split_of(F.col("g")))
    assert one.groupBy("g").agg(F.countDistinct("s").alias("n")).where("n > 1").count() == 0
    assert one.exceptAll(two).count() == 0


@pytest.mark.parametrize(
    ("text", "tool", "param", "value", "says"),
    [
        ("để hai mươi bảy độ", "set_climate", "temperature", "27", True),
        ("mở cửa ghế phụ", "open_window", "position", '"passenger"', True),
        ("mở cửa ghế lái", "open_window", "position", '"rear_left"', False),
        ("qua nui ba den di", "navigate_to", "destination", '"núi Bà Đen"', True),
        ("qua núi Cấm", "navigate_to", "destination", '"núi Bà Đen"', False),
        ("w 219 nghĩa là sao", "lookup_sign", "code", '"W.219"', True),
        ("nhắc sau nửa tiếng", "set_reminder", "minutes", "30", True),
        ("nhắc mua sữa", "set_reminder", "text", '"mua sữa cho con"', True),
        ("nhắc đón bạn", "set_reminder", "text", '"mua sữa cho con"', False),
        ("tránh phí nhé", "navigate_to", "avoid_tolls", "true", True),
    ],
)
def test_mentions(spark, text, tool, param, value, says):
    got = spark.range(1).select(dataset.mentions_value(F.lit(text), F.lit(tool), F.lit(param), F.parse_json(F.lit(value))).alias("x")).first()["x"]
    assert got is says


def record(spark, **change):
    base = {"scenario": "single", "user": "mở âm lượng mức 5", "user_raw": "", "first_raw": "", "gold": '{"kind":"call","calls":[{"name":"set_volume","arguments":{"level":5}}]}', "state": "{}", "calls": '[{"name":"set_volume","arguments":{"level":5}}]', "omitted": None, "omitted_value": None, "history": None}
    base |= change
    row = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} string" for k in base))
    history = F.from_json("history", "array<struct<role: string, content: string>>")
    return row.select("scenario", "user", "user_raw", "first_raw", P.action_from_json(F.col("gold")).alias("gold"), U.state_from_json(F.col("state")).alias("state"), F.struct(seeds.calls_from_json(F.col("calls")).alias("calls"), "omitted", F.parse_json("omitted_value").alias("omitted_value")).alias("seed"), history.alias("history"))


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({}, None),
        ({"user": "mở âm lượng"}, "câu không nhắc set_volume.level=5"),
        ({"gold": '{"kind":"call","calls":[{"name":"set_volume","arguments":{"level":50}}]}'}, "set_volume.level: 50 > 30"),
        ({"gold": '{"kind":"call","calls":[{"name":"unlock_doors"}]}', "calls": "[]", "state": '{"speed_kmh": 50}'}, "gold gọi tool nhưng luật an toàn chặn"),
        ({"user": "âm lượng mức 5 nhưng chưa nói mức nào"}, "câu chép lại đề bài"),
        ({"user": "Bạn muốn âm lượng 5"}, "câu người dùng lại là câu hỏi của trợ lý"),
        ({"user": "can you set the volume to 5 please"}, "câu gần như toàn tiếng Anh"),
        ({"scenario": "chitchat", "calls": "[]", "gold": '{"kind":"reply","text":"Đã xong rồi nhé."}'}, "chitchat bịa là đã làm / bịa thông tin"),
        ({"scenario": "chitchat", "calls": "[]", "gold": '{"kind":"reply","text":"Trời đẹp, 28 độ."}'}, "chitchat bịa số liệu"),
        ({"scenario": "chitchat", "calls": "[]", "gold": '{"kind":"reply","text":"Hello."}'}, "chitchat trả lời không phải tiếng Việt"),
        ({"scenario": "missing", "user": "mở âm lượng 5", "calls": '[{"name":"set_volume","arguments":{}}]', "omitted": "level", "omitted_value": "5", "gold": '{"kind":"ask","text":"Bạn muốn mức mấy?"}'}, "kịch bản thiếu slot số nhưng câu có chữ số"),
        ({"scenario": "followup"}, "followup thiếu history"),
        ({"gold": '{"kind":"ask","text":"Chào bạn."}'}, "text gold bị phân loại thành reply thay vì ask"),
    ],
)
def test_record_problems(spark, change, problem):
    got = record(spark, **change).select(dataset.record_problems().alias("x")).first()["x"]
    assert (got[0] if got else None) == problem


def test_seeds_have_right_labels(spark):
    rows = stored(seeds.sample_seeds(spark, 400, seed=5), "seeds")
    assert rows.where(~seeds.check_seed_label()).count() == 0
    bad = rows.select("scenario", F.flatten(F.transform("calls", lambda c: U.validate_call(c["name"], c["arguments"]))).alias("e")).where("scenario NOT IN ('missing', 'law') AND size(e) > 0")
    assert bad.count() == 0
    labelled = rows.select("scenario", seeds.gold_action(F.lit("câu hỏi"), F.lit("Chào bạn.")).alias("g"))
    kinds = {(r.scenario, r.kind) for r in labelled.select("scenario", "g.kind").distinct().collect()}
    assert kinds <= {("single", "call"), ("multi", "call"), ("followup", "call"), ("law", "call"), ("missing", "ask"), ("unsafe", "refuse"), ("unsafe", "ask"), ("chitchat", "reply")}
    assert rows.select("group").where("group IS NULL").count() == 0
    again = seeds.sample_seeds(spark, 200, seed=5).select("id", "group")
    assert again.exceptAll(rows.select("id", "group")).count() == 0


def write_all():
    def complete(system, prompt):
        out = []
        for item in json.loads(prompt.split("\n", 1)[1]):
            said = item["yeu_cau"].split("muốn ", 1)[-1].replace('"', " ")
            out.append({"id": item["id"], "user": f"nhờ {said}", "first": "mở giúp mình nhé", "reply": "Chúc bạn một ngày vui."})
        return "Đây: " + json.dumps({"items": out}, ensure_ascii=False)

    return complete


def test_end_to_end(spark, tmp_path):
    own = stored(seeds.sample_seeds(spark, 120, seed=2), "seeds")
    records = stored(writer.generate(own, None, write_all, seed=2), "records")
    assert records.count() == 120
    flat = records.select("id", F.to_json(F.struct("user", "style")).alias("x"))
    assert files.append_new(spark, flat, str(tmp_path / "raw")) == 120
    assert files.append_new(spark, flat, str(tmp_path / "raw")) == 0
    done = spark.read.schema("id string").json(str(tmp_path / "raw"))
    assert writer.generate(own, done, write_all, seed=2).count() == 0
    kept, report = dataset.build(records, F.col("id"))
    assert report["raw"] == report["invalid"] + report["duplicates"] + sum(s["n"] for s in report["splits"].values())
    files.write_splits(kept.select("id", "user", "split"), str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), "id string, user string").count() == kept.count()
    made = pairs.build_pairs(records, seed=1, per_record=2)
    assert made.groupBy("id", "type").count().where("count > 1").count() == 0
    answers = {r.user: r.raw for r in records.where("gold.kind = 'call'").select("user", F.concat(F.lit("<tool_call>"), F.to_json("gold.calls"), F.lit("</tool_call>")).alias("raw")).collect()}
    rows = stored(predict(records, lambda: Scripted(answers), "scripted", "synth"), "predictions")
    assert rows.count() == 120
    failed = rows.where("NOT pred.valid_format").count()
    assert failed == records.where(~F.col("user").isin(*answers)).count() > 0
    results = [r.asDict() for r in metrics.report(rows).collect()]
    assert [r["variant"] for r in results] == ["raw", "guarded"] and results[0]["tool_acc"] == 1.0
    assert "| scripted | synth | 120 |" in files.report_markdown(results) and "scripted/synth" in files.report_json(results)


def test_augmentation_keeps_arguments(spark):
    own = stored(seeds.sample_seeds(spark, 300, seed=9, scenario="single"), "seeds")
    rows = stored(writer.generate(own, None, write_all, seed=9), "records")
    bare = rows.where("style LIKE '%no_diacritics%'")
    assert 0 < bare.count() < 120
    said = bare.select("user", F.explode("gold.calls").alias("c")).select("user", F.explode("c.arguments")).where("schema_of_variant(value) = 'STRING'")
    assert all(r.x.isascii() for r in said.select(F.expr("cast(value as string)").alias("x")).collect())


def test_broken_answers_are_tolerated(spark):
    items = lambda s: spark.range(1).select(writer.parse_items(F.lit(s)).alias("x")).first()["x"]
    assert items("garbage") == []
    assert [i["id"] for i in items('x {"items": [{"id": 1, "user": "a"}, {"id": 2}, {"id": 1, "user": "b"}]} y')] == ["1"]
    assert items('[{"id": "a", "user": "u"}]')[0]["user"] == "u"


METRIC_ROWS = [
    ("single", '{"kind":"call","calls":[{"name":"set_volume","arguments":{"level":5}}]}', '{"kind":"call","calls":[{"name":"set_volume","arguments":{"level":5}}]}'),
    ("single", '{"kind":"call","calls":[{"name":"set_climate","arguments":{"temperature":22,"mode":"cool"}}]}', '{"kind":"call","calls":[{"name":"set_climate","arguments":{"temperature":25}}]}'),
    ("single", '{"kind":"call","calls":[{"name":"set_fan_speed","arguments":{"level":3}}]}', '{"kind":"call","calls":[{"name":"set_fan","arguments":{"level":3}}]}'),
    ("missing", '{"kind":"ask","text":"x?"}', '{"kind":"ask","text":"y?"}'),
    ("unsafe", '{"kind":"refuse","text":"x"}', '{"kind":"call","calls":[{"name":"unlock_doors"}]}'),
    ("chitchat", '{"kind":"reply","text":"x"}', '{"kind":"refuse","text":"y"}'),
]


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(s, g, p, float(i), 10.0) for i, (s, g, p) in enumerate(METRIC_ROWS)], "scenario string, g string, p string, latency_s double, tokens_per_s double")
    rows = rows.select("scenario", P.action_from_json(F.col("g")).alias("gold"), P.action_from_json(F.col("p")).alias("pred"), "latency_s", "tokens_per_s")
    m = metrics.compute_metrics(rows).first().asDict()
    assert m["kind_acc"] == 0.6667 and m["exact"] == 0.3333 and m["tool_acc"] == 0.6667 and m["args_exact"] == 0.3333
    assert (m["tp"], m["fp"], m["fn"]) == (1, 2, 3) and m["arg_f1"] == pytest.approx(2 / 7, abs=1e-4)
    assert m["hallucinated_tool"] == 0.25 and m["ask_precision"] == 1.0 and m["unsafe_call"] == 1.0 and m["false_refusal"] == 0.2
    assert m["multi_exact"] is None and m["refuse_recall"] == 0.0 and m["latency_p50_s"] == 2.5 and m["latency_p95_s"] == 5.0
    assert m["exact_by_scenario"] == {"chitchat": 0.0, "missing": 1.0, "single": 0.3333, "unsafe": 0.0}


def test_places_of_values(spark):
    rows = spark.range(20).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v")).union(spark.createDataFrame([("b", 3.0), ("b", None), ("b", 3.0), (None, 1.0)], "k string, v double"))
    got = {r.k: r for r in metrics.at_places(rows, ["k"], "v", metrics.MEDIAN | {"p95": metrics.percentile_place(0.95)}).collect()}
    assert (got["a"].low, got["a"].high, got["a"].p95, got["a"].n) == (9.0, 10.0, 19.0, 20)
    assert (got["b"].low, got["b"].high, got["b"].n) == (3.0, 3.0, 2) and got[None].p95 == 1.0
    assert metrics.at_places(rows, [], "v", {"least": lambda n: F.lit(1)}).first()["least"] == 0.0
    lengths = metrics.length_stats(rows.where("k = 'a'"), ["k"], "v").first()
    assert (lengths.p50, lengths.most, lengths["mean"]) == (10.0, 19.0, 9.5)


def test_perturbations_never_match(spark):
    own = stored(writer.generate(seeds.sample_seeds(spark, 150, seed=4), None, write_all, seed=4), "records")
    rows = own.select("gold", F.explode(pairs.perturbed(3)).alias("x"))
    from callweave.functions.values import actions_match

    assert rows.where(actions_match(F.col("gold"), F.col("x.action"))).count() == 0
    kinds = {r.type for r in rows.select("x.type").distinct().collect()}
    assert {"wrong_tool", "hallucinated_tool", "wrong_value", "wrong_unit", "missing_arg", "dropped_call", "over_refuse", "guess_instead_of_ask", "comply_unsafe", "spurious_call"} <= kinds


def test_on_policy(spark):
    rows = record(spark).withColumn("id", F.lit("a"))
    pred = lambda raw: spark.createDataFrame([("a", raw)], "id string, raw string").select("id", P.parse_output(F.col("raw")).alias("pred"))
    assert pairs.mine_on_policy(rows, pred('{"name":"set_volume","arguments":{"level":5}}')).count() == 0
    broken = pairs.mine_on_policy(rows, pred('<tool_call>{"name"</tool_call><|im_end|>')).first()
    assert broken["rejected"]["content"] == '<tool_call>{"name"</tool_call>' and broken["type"] == "on_policy"
    with pytest.raises(Exception, match="no prediction"):
        pairs.mine_on_policy(rows, pred("x").where("id = 'b'")).collect()


def test_chat_shapes(spark):
    row = record(spark, history='[{"role":"user","content":"a"},{"role":"assistant","content":"b?"}]')
    rows = row.withColumn("m", chat.record_messages(F.col("user"), F.col("state"), F.col("history"), F.col("gold")))
    m = json.loads(rows.select(F.to_json(chat.to_api_messages(F.col("m")))).first()[0])
    assert [x["role"] for x in m] == ["system", "user", "assistant", "user", "assistant"]
    assert m[4]["tool_calls"][0]["id"] == "call_4_0" and json.loads(m[4]["tool_calls"][0]["function"]["arguments"]) == {"level": 5}
    p = json.loads(rows.select(F.to_json(chat.to_parts(F.col("m")))).first()[0])
    assert p["system"] == chat.SYSTEM and p["contents"][-1] == {"role": "model", "parts": [{"functionCall": {"name": "set_volume", "args": {"level": 5}}}]}
    two = rows.select(chat.split_prompt_completion(F.col("m"), lambda x, g: chat.render_chatml(x, None, g)).alias("x")).first()["x"]
    assert two["prompt"].endswith("<think>\n\n</think>\n\n") and two["completion"] == '<tool_call>\n{"name": "set_volume", "arguments": {"level":5}}\n</tool_call><|im_end|>\n'
    back = spark.range(1).select(chat.from_parts(F.lit('{"candidates":[{"content":{"parts":[{"text":"x","thought":true},{"text":"y"},{"functionCall":{"name":"a","args":{"k":1}}}]}}]}')).alias("x")).first()["x"]
    assert back["content"] == "y" and json.loads(back["tool_calls"][0])["function"] == {"name": "a", "arguments": {"k": 1}}
    assert spark.range(1).select(chat.from_parts(F.lit("{}")).alias("x")).first()["x"]["content"] == ""


def test_server_tools():
    from callweave.functions.registry import openai_tools

    own = chat.parts_tools(openai_tools(["lock_doors", "set_volume"]))[0]["functionDeclarations"]
    assert "parameters" not in own[0] and own[1]["parameters"]["properties"]["level"]["type"] == "INTEGER"


def test_token_rows(spark):
    row = lambda n: spark.range(1).select(chat.token_rows(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)), n).alias("x")).first()["x"]
    assert row(3)["labels"] == [-100, -100, 3] and row(2) is None
    assert chat.plan_steps(160, 16, 2, 500, 1000, 60) == 20 and chat.plan_steps(10, 16, 0.1, 500, 1, 0.1) == 1


def test_templates(spark):
    row = record(spark).withColumn("m", chat.record_messages(F.col("user"), F.col("state"), F.col("history"), F.col("gold")))
    own = chat.Template(begin="<s>", open="[{role}] ", close="\n", roles=(("assistant", "model"),), tools=" tools={tools}", call="CALL {call}", thought="")
    text = row.select(chat.render(F.col("m"), own, "[]").alias("x")).first()["x"]
    assert text.startswith("<s>[system] ") and " tools=[]\n[user] <xe>" in text
    assert text.endswith('[model] CALL {"name": "set_volume", "arguments": {"level":5}}\n[model] ')
    with pytest.raises(ImportError):  # jinja2 is not installed here
        chat.render_jinja(F.col("m"), "{{ messages }}")


def test_sinks_and_freshness(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "id string, type string")
    assert files.write_pairs(rows, str(tmp_path / "pairs")) == {"x": 2, "y": 1}
    path = str(tmp_path / "pairs")
    assert files.done(spark, path, 3) and not files.done(spark, path, 2) and not files.done(spark, str(tmp_path / "none"), 0)
    time.sleep(1.1)
    files.write_pairs(rows, str(tmp_path / "later"))
    assert files.done(spark, str(tmp_path / "later"), 3, path) and not files.done(spark, path, 3, str(tmp_path / "later"))
    assert [r.id for r in files.head(rows, F.col("id"), 2).collect()] == ["a", "b"]


def test_scratch_goes_with_its_scope(spark):
    base = storage.folder(spark)
    there = lambda: {f.getPath().getName() for f in spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jvm.java.net.URI(base), spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(base))}
    stored(spark.range(1), "outside")
    before, conf = there(), dict(spark.conf.getAll)
    with storage.scope(spark):
        rows = spark.createDataFrame([(i, "a", "bat dieu hoa len") for i in range(9)], "seq int, key string, text string")
        assert dedup.dedupe(rows, F.col("seq"), F.col("key"), F.col("text")).where("duplicate").count() == 8
        assert there() > before
    assert there() == before and dict(spark.conf.getAll) == conf


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Session.conf)

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.folder(Session)


def test_client_policy():
    slept, asked = [], []

    def transport(*answers):
        left = list(answers)

        def send(model, system, user, temperature, json_mode):
            asked.append(model)
            return left.pop(0)

        return send

    A = writer.Answer
    assert writer.Client(transport(A(429, "limit per day"), A(200, "ok")), ["big", "small"], sleep=slept.append).complete("s", "u") == "ok"
    assert asked == ["big", "small"] and slept == []
    asked.clear()
    assert writer.Client(transport(A(429, "slow", {"retry-after": "7"}), A(503), A(0), A(200, "ok")), ["big"], sleep=slept.append).complete("s", "u") == "ok"
    assert asked == ["big"] * 4 and slept == [7.0, 4, 6]
    with pytest.raises(writer.WriterError, match="daily quota"):
        writer.Client(transport(A(429, "(TPD)")), ["big"], sleep=slept.append).complete("s", "u")
    with pytest.raises(writer.WriterError, match="400"):
        writer.Client(transport(A(400, "bad")), ["big"], sleep=slept.append).complete("s", "u")


def test_streamed_guard(spark, tmp_path):
    rows = [("a", '{"name":"unlock_doors"}', '{"speed_kmh": 50}'), ("b", "Chào bạn.", None), ("a", '{"name":"unlock_doors"}', '{"speed_kmh": 50}')]
    spark.createDataFrame(rows, "id string, raw string, state string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, raw string, state string").json(str(tmp_path / "in"))
    append_once(guarded(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(60)
    append_once(guarded(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint2")).awaitTermination(60)
    got = {r.id: json.loads(r.guarded)["kind"] for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {"a": "refuse", "b": "reply"} and spark.read.json(str(tmp_path / "out")).count() == 2


def test_sampling(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("type"))
    first, rest = rows.where("id < 10"), rows.where("id >= 10")
    both = pairs.capped_union(first, rest, 30, seed=1)
    assert both.count() == 30 and both.join(first, "id", "left_semi").count() == 10
    assert pairs.sampled(rows, F.col("id"), 5, 1).collect() == pairs.sampled(rows.repartition(7), F.col("id"), 5, 1).collect()
    assert pairs.per_group(rows, F.col("type"), F.col("id"), 3).count() == 3


def test_tables_of_the_registry(spark):
    from callweave.functions import registry as R

    assert R.tools_frame(spark).where("param IS NOT NULL").count() == sum(len(t.params) for t in R.TOOLS)
    assert R.aliases_frame(spark).where("tool = 'set_lights' AND value = 'off'").count() == 3
