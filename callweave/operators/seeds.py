"""Seeds of dataset records, their labels, instructions and records: all chance is a hash of (seed, id, purpose).

A seed is a row: id, scenario, style, calls, state, omitted, omitted_value, topic, group. The same ids give the same seeds
under any partitioning, and a resumed run the same as a whole one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions.rules import STATE, action, check_call, check_calls, state_of
from ..functions.text import add_typo, fold, let, once, pick, unit, weighted
from ..functions.values import CALL, CALLS, arguments_of, as_double, as_text, is_number, kind, spelled

# Shares of scenarios and styles, and what styles mean.
SCENARIOS = {"single": 0.34, "multi": 0.12, "missing": 0.12, "followup": 0.08, "unsafe": 0.12, "law": 0.11, "chitchat": 0.11}
STYLES = {
    "standard": "câu bình thường, rõ ràng",
    "colloquial": "văn nói đời thường, có từ đệm (ơi, nhé, đi, xíu, cái), có thể nói trống không",
    "code_switch": "câu tiếng Việt, chỉ chen 1-3 từ tiếng Anh kiểu dân văn phòng (AC, volume, navigation, mode, fan, call, play); KHÔNG viết cả câu bằng tiếng Anh",
    "southern": "giọng miền Nam (nha, nghen, hen, máy lạnh, quẹo, mở nhạc, kêu)",
    "northern": "giọng miền Bắc (nhé, điều hoà, rẽ, bật, gọi cho)",
    "short": "ra lệnh rất ngắn, 3-7 chữ, vẫn đủ giá trị",
}
STYLE_WEIGHTS = {"standard": 0.2, "colloquial": 0.25, "code_switch": 0.15, "southern": 0.15, "northern": 0.15, "short": 0.1}
SINGLE_TOOLS = tuple(t for t in R.TOOL_NAMES if t != "lookup_traffic_law")
MULTI_TOOLS = tuple(t for t in R.TOOL_NAMES if t not in ("unlock_doors", "lookup_traffic_law", "lookup_sign"))
NO_DIACRITICS, TYPO, TRIES = 0.15, 0.08, 30


def _text(key: str, options, u: Column) -> Column:
    return F.concat(F.lit(f'"{key}":"'), pick(R.literal(options), u), F.lit('"'))


def _raw(key: str, options, u: Column) -> Column:
    return F.concat(F.lit(f'"{key}":'), pick(R.literal([str(o) for o in options]), u))


def sample_args(tool: Column, u) -> Column:
    """JSON text of a tool's arguments; u(purpose) gives chance."""
    enum = lambda name, param: next(p.enum for p in R.BY_NAME[name].params if p.name == param)
    maybe = lambda share, purpose, x: F.when(u(purpose) < share, x)
    degrees = F.when(u("half") < 0.9, _raw("temperature", range(16, 31), u("t"))).otherwise(_raw("temperature", (20.5, 22.5, 24.5), u("t")))
    parts = {
        "set_climate": [maybe(0.75, "has_t", degrees), maybe(0.3, "has_zone", _text("zone", enum("set_climate", "zone"), u("zone"))), maybe(0.3, "has_mode", _text("mode", enum("set_climate", "mode"), u("mode")))],
        "set_fan_speed": [_raw("level", range(1, 8), u("level"))],
        "navigate_to": [_text("destination", R.DESTINATIONS, u("destination")), maybe(0.2, "tolls", F.lit('"avoid_tolls":true'))],
        "find_charging_station": [maybe(0.4, "has_km", _raw("max_distance_km", (5, 10, 20, 30, 50), u("km"))), maybe(0.4, "fast", F.lit('"fast_only":true'))],
        "play_music": [maybe(0.85, "has_query", _text("query", R.MUSIC, u("query")))],
        "set_volume": [_raw("level", range(31), u("level"))],
        "call_contact": [_text("name", R.CONTACTS, u("name"))],
        "read_messages": [maybe(0.4, "has_count", _raw("count", (1, 2, 3, 5), u("count")))],
        "get_vehicle_status": [_text("field", enum("get_vehicle_status", "field"), u("field"))],
        "open_window": [_text("position", enum("open_window", "position"), u("position")), maybe(0.6, "has_percent", _raw("percent", (0, 20, 30, 50, 100), u("percent")))],
        "set_lights": [_text("mode", enum("set_lights", "mode"), u("mode"))],
        "set_drive_mode": [_text("mode", enum("set_drive_mode", "mode"), u("mode"))],
        "set_reminder": [_text("text", R.REMINDERS, u("text")), _raw("minutes", R.MINUTES, u("minutes"))],
        "lookup_sign": [_text("code", R.SIGN_CODES, u("code"))],
    }
    out = F.when((tool == "set_climate") & (u("off") < 0.15), F.lit('{"power":"off"}'))
    for name, own in parts.items():
        out = out.when(tool == name, F.concat(F.lit("{"), F.concat_ws(",", *own), F.lit("}")))
    return out.otherwise(F.lit("{}"))


def sample_state(u, speed: Column | None = None, night: Column | None = None) -> Column:
    """A state by chance, with a speed or a time of day if given."""
    fast = (pick(F.array(*map(F.lit, (0, 0, 0, 20, 40, 60, 80, 100, 120))), u("speed")) if speed is None else speed).cast("double")

    def of(x: Column) -> Column:
        moving = x["fast"] > 0
        battery = (F.floor(u("battery") * 96) + 5).cast("int")
        return state_of(
            {
                "speed_kmh": x["fast"],
                "gear": F.when(moving, F.lit("D")).otherwise(pick(F.array(*map(F.lit, "PPD")), u("gear"))),
                "is_night": (u("night") < 0.35) if night is None else night,
                "battery_pct": battery,
                "range_km": F.floor(battery * F.lit(4.2).cast("double")).cast("int"),
                "doors_locked": moving | (u("locked") < 0.5),
                "cabin_temp_c": F.floor(u("cabin") * 19) + 18,
                "outside_temp_c": F.floor(u("outside") * 25) + 15,
            }
        )

    return let(F.struct(fast.alias("fast")), of)


def safe_state(calls: Column, u) -> Column:
    """The first of TRIES states by chance in which all calls are allowed, else one standing by day."""
    tries = F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda k: sample_state(lambda purpose: u(purpose, k)))
    good = F.filter(tries, lambda s: check_calls(calls, s)["decision"] == "allow")
    return F.coalesce(F.try_element_at(good, F.lit(1)), sample_state(lambda purpose: u(purpose, F.lit("parked")), F.lit(0), F.lit(False)))


def _call_json(tool: Column, args: Column) -> Column:
    return F.concat(F.lit('{"name":"'), tool, F.lit('","arguments":'), args, F.lit("}"))


def calls_from_json(json: Column) -> Column:
    """Calls from the JSON text of an array of calls, arguments in their order."""
    rows = F.from_json(json, "array<struct<name: string, arguments: string>>")
    return F.transform(rows, lambda c: F.struct(c["name"].alias("name"), arguments_of(c["arguments"]).alias("arguments")).cast(CALL)).cast(CALLS)


def group_key(scenario: Column, calls: Column, omitted: Column, topic: Column) -> Column:
    """What all records of one request share: scenario, calls with their arguments in order of keys, omitted slot, topic."""
    one = lambda c: F.concat(c["name"], F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(c["arguments"])), lambda k: F.concat(F.lit('"'), k, F.lit('": '), F.to_json(F.try_element_at(c["arguments"], k)))), ", "), F.lit("}"))
    return F.concat(scenario, F.lit("|"), F.array_join(F.transform(calls, one), ";"), F.lit("|"), F.coalesce(omitted, F.lit("")), F.lit("|"), F.coalesce(topic, F.lit("")))


def sample_seeds(spark: SparkSession, n: int, seed: int = 0, scenario: str | None = None) -> DataFrame:
    """n seeds, s000000 on; of one scenario if named."""
    i = F.col("i").cast("string")

    def u(purpose: str, *more) -> Column:
        return unit(seed, i, purpose, *more)

    slots = F.array(*(F.struct(F.lit(a).alias("tool"), F.lit(b).alias("slot")) for a, b in R.ASK))
    unsafe = pick(F.array(*map(F.lit, ("unlock", "unlock", "lights", "window"))), u("unsafe"))
    window = F.concat(F.lit("{"), F.concat_ws(",", _text("position", R.BY_NAME["open_window"].params[0].enum, u("w_position")), F.when(u("w_has") < 0.75, _raw("percent", (50, 80, 100), u("w_percent")))), F.lit("}"))
    base = spark.range(n).withColumnRenamed("id", "i").select(
        "i",
        F.concat(F.lit("s"), F.lpad(i, 6, "0")).alias("id"),
        (F.lit(scenario) if scenario else weighted(SCENARIOS, u("scenario"))).alias("scenario"),
        weighted(STYLE_WEIGHTS, u("style")).alias("style"),
        pick(slots, u("slot")).alias("slot"),
        unsafe.alias("unsafe"),
        pick(R.literal(SINGLE_TOOLS), u("single")).alias("single"),
        # two different ones: the second by its distance from the first
        F.floor(u("first") * len(MULTI_TOOLS)).cast("int").alias("a"),
        (F.floor(u("second") * (len(MULTI_TOOLS) - 1)) + 1).cast("int").alias("step"),
    )
    sc = F.col("scenario")
    multi = R.literal(MULTI_TOOLS)
    first, second = F.element_at(multi, F.col("a") + 1), F.element_at(multi, ((F.col("a") + F.col("step")) % len(MULTI_TOOLS)) + 1)
    args = lambda tool, salt: sample_args(tool, lambda purpose: u(purpose, salt))
    unsafe_call = F.when(F.col("unsafe") == "unlock", F.lit('{"name":"unlock_doors","arguments":{}}')).when(F.col("unsafe") == "lights", F.lit('{"name":"set_lights","arguments":{"mode":"off"}}')).otherwise(_call_json(F.lit("open_window"), window))
    listed = F.concat(
        F.lit("["),
        F.when(sc == "single", _call_json(F.col("single"), args(F.col("single"), 0)))
        .when(sc == "multi", F.concat(_call_json(first, args(first, 0)), F.lit(","), _call_json(second, args(second, 1))))
        .when(sc.isin("missing", "followup"), _call_json(F.col("slot.tool"), args(F.col("slot.tool"), 0)))
        .when(sc == "unsafe", unsafe_call)
        .when(sc == "law", F.lit('{"name":"lookup_traffic_law","arguments":{}}'))
        .otherwise(F.lit("")),
        F.lit("]"),
    )
    whole = base.withColumn("whole", calls_from_json(listed))
    speeds = lambda options, purpose: pick(F.array(*map(F.lit, options)), u(purpose))
    danger = F.when(F.col("unsafe") == "unlock", speeds((10, 30, 50, 80), "danger")).when(F.col("unsafe") == "lights", speeds((20, 40, 60, 90), "danger")).otherwise(speeds((90, 100, 110, 120), "danger"))
    dark = F.when(F.col("unsafe") == "lights", F.lit(True)).otherwise(u("dark") < 0.35)
    state = F.when(sc == "unsafe", sample_state(u, danger, dark)).when(sc.isin("law", "chitchat"), sample_state(u)).otherwise(safe_state(F.col("whole"), u))
    slot = F.when(sc.isin("missing", "followup"), F.col("slot.slot"))
    less = F.transform(F.col("whole"), lambda c: F.struct(c["name"].alias("name"), F.map_filter(c["arguments"], lambda k, v: k != F.col("slot.slot")).alias("arguments")).cast(CALL)).cast(CALLS)
    topic = F.when(sc == "law", pick(R.literal(R.LAW_TOPICS), u("topic"))).when(sc == "chitchat", pick(R.literal(R.CHITCHAT_TOPICS), u("topic")))
    out = whole.select(
        "id",
        "scenario",
        "style",
        F.when(sc == "missing", less).otherwise(F.col("whole")).alias("calls"),
        state.cast(STATE).alias("state"),
        slot.alias("omitted"),
        F.when(slot.isNotNull(), F.try_element_at(F.element_at("whole", 1)["arguments"], slot)).alias("omitted_value"),
        topic.alias("topic"),
    )
    return out.withColumn("group", group_key(F.col("scenario"), F.col("calls"), F.col("omitted"), F.col("topic")))


def check_seed_label() -> Column:
    """Whether an unsafe seed's call is indeed not allowed; true for other scenarios."""
    c = F.element_at("calls", 1)
    return F.when(F.col("scenario") != "unsafe", F.lit(True)).otherwise(check_call(c["name"], c["arguments"], F.col("state"))["decision"] != "allow")


def ask_text(tool: Column, slot: Column) -> Column:
    return R.lookup(R.dotted(R.ASK), F.concat(tool, F.lit("."), slot))


def gold_action(user: Column, reply: Column) -> Column:
    """The right action for a seed's row and its user's text."""
    sc, calls = F.col("scenario"), F.col("calls")
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    law = F.array(F.struct(F.lit("lookup_traffic_law").alias("name"), F.create_map(F.lit("question"), F.parse_json(F.to_json(strip(user).cast("variant")))).alias("arguments"))).cast(CALLS)
    by_rules = let(
        check_calls(calls, F.col("state")),
        lambda v: F.when(v["decision"] == "refuse", action(F.lit("refuse"), None, v["message"])).when(v["decision"] == "confirm", action(F.lit("ask"), None, v["message"])).otherwise(action(F.lit("call"), calls)),
    )
    return (
        F.when(sc == "chitchat", action(F.lit("reply"), None, strip(reply)))
        .when(sc == "law", action(F.lit("call"), law))
        .when(sc == "missing", action(F.lit("ask"), None, ask_text(F.element_at("calls", 1)["name"], F.col("omitted"))))
        .otherwise(by_rules)
    )


@once
def describe_value(tool: Column, param: Column, value: Column) -> Column:
    """How an instruction says an argument."""
    path = F.concat(tool, F.lit("."), param)
    first = R.lookup({f"{a}.{b}.{str(v).lower() if isinstance(v, bool) else v}": ps[0] for (a, b), vs in R.ALIASES.items() for v, ps in vs.items()}, F.concat(path, F.lit("."), F.coalesce(as_text(value), F.lit(""))))
    label = F.coalesce(R.lookup({k: v[0] for k, v in R.dotted(R.PARAM_LABELS).items()}, path), param)
    measure = F.coalesce(R.lookup({k: v[1] for k, v in R.dotted(R.PARAM_LABELS).items()}, path), F.lit(""))
    return (
        F.when(path.isin(*R.dotted(R.ALIASES)), first)
        .when((path == "open_window.percent") & (as_double(value) == 0), F.lit("đóng hẳn"))
        .when(path == "open_window.percent", F.concat(F.lit("mở "), spelled(as_double(value)), F.lit("%")))
        .when(kind(value) == "str", F.concat(label, F.lit(' "'), as_text(value), F.lit('"')))
        .otherwise(F.concat(label, F.lit(" "), spelled(as_double(value)), measure))
    )


@once
def describe_call(name: Column, arguments: Column) -> Column:
    """How an instruction says a call."""
    percent = F.try_element_at(arguments, F.lit("percent"))
    shut = F.coalesce((name == "open_window") & is_number(percent) & (as_double(percent) == 0), F.lit(False))
    off = F.coalesce((name == "set_climate") & (as_text(F.try_element_at(arguments, F.lit("power"))) == "off"), F.lit(False))
    head = F.when(shut, F.lit("đóng cửa sổ")).otherwise(R.lookup(R.TOOL_PHRASES, name))
    parts = F.transform(F.filter(F.map_entries(arguments), lambda e: ~(shut & (e["key"] == "percent"))), lambda e: describe_value(name, e["key"], e["value"]))
    return F.when(off, F.lit("tắt điều hoà")).otherwise(F.concat(head, F.when(F.size(parts) > 0, F.concat(F.lit(": "), F.array_join(parts, ", "))).otherwise(F.lit(""))))


def seed_instruction() -> Column:
    """JSON text of the writer's instruction for a seed's row: id, van_phong, yeu_cau and, where more than the user's text is asked for, truong."""
    sc, calls = F.col("scenario"), F.col("calls")
    c, d = F.try_element_at(calls, F.lit(1)), F.try_element_at(calls, F.lit(2))
    none = F.create_map().cast("map<string,variant>")
    slot = F.coalesce(R.lookup({k: v[0] for k, v in R.dotted(R.PARAM_LABELS).items()}, F.concat(c["name"], F.lit("."), F.col("omitted"))), F.col("omitted"))
    only = describe_call(c["name"], F.map_filter(c["arguments"], lambda k, v: k == F.col("omitted")))
    others = F.map_filter(c["arguments"], lambda k, v: k != F.col("omitted"))
    answer = F.regexp_replace(only, r"^.*?: ", "")
    follow = F.concat(
        F.lit("Hai lượt. 'first': người dùng muốn "), describe_call(c["name"], none), F.lit(" nhưng không nói "), slot,
        F.lit('. Trợ lý hỏi lại: "'), ask_text(c["name"], F.col("omitted")), F.lit("\". 'user': người dùng trả lời ngắn gọn ("), answer, F.lit(")."),
        F.when(F.size(others) > 0, F.concat(F.lit(" Lượt 'first' có nói: "), describe_call(c["name"], others), F.lit("."))).otherwise(F.lit("")),
    )
    # Fixed value: what a small-talk item asks for.
    chat = F.concat(
        F.lit("Người dùng nói chuyện ngoài lề: "), F.col("topic"),
        F.lit(
            ". Thêm trường 'reply': trợ lý đáp 1-2 câu ngắn bằng tiếng Việt, thân thiện, KHÔNG dùng 'xin lỗi', 'không thể', không đặt câu hỏi "
            "lại. Việc trợ lý trên xe không làm được (đặt vé, đặt bàn...) hoặc cần tin mới (giá vàng, thời tiết, bóng đá...) thì nói nhẹ nhàng "
            "là mình chưa có thông tin đó / bạn xem trên điện thoại nhé. KHÔNG bịa thông tin, KHÔNG nói là đã làm xong."
        ),
    )
    wish = (
        F.when(sc.isin("single", "unsafe"), F.concat(F.lit("Người dùng muốn "), describe_call(c["name"], c["arguments"]), F.lit(".")))
        .when(sc == "multi", F.concat(F.lit("Người dùng yêu cầu HAI việc trong MỘT câu: (1) "), describe_call(c["name"], c["arguments"]), F.lit("; (2) "), describe_call(d["name"], d["arguments"]), F.lit(".")))
        .when(sc == "missing", F.concat(F.lit("Người dùng muốn "), describe_call(c["name"], c["arguments"]), F.lit(", nhưng KHÔNG nói "), slot, F.lit(". Câu phải thiếu đúng thông tin đó.")))
        .when(sc == "followup", follow)
        .when(sc == "law", F.concat(F.lit("Người dùng hỏi về luật giao thông: "), F.col("topic"), F.lit(". Hỏi tự nhiên như đang lái xe.")))
        .otherwise(chat)
    )
    asked = F.when(sc == "followup", F.lit("first, user")).when(sc == "chitchat", F.lit("user, reply"))
    return F.to_json(F.struct(F.col("id").alias("id"), R.lookup(STYLES, F.col("style")).alias("van_phong"), wish.alias("yeu_cau"), asked.alias("truong")))


def prompts(seeds: DataFrame, batch_size: int = 8) -> DataFrame:
    """batch, ids, prompt: one prompt for batch_size seeds, by the number in their ids."""
    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    rows = seeds.select("id", seed_instruction().alias("item"), F.floor(number / batch_size).alias("batch"))
    own = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("id", "item"))).alias("x"))
    return own.select("batch", F.col("x.id").alias("ids"), F.concat(F.lit("Các mục:\n["), F.array_join(F.col("x.item"), ",\n"), F.lit("]")).alias("prompt"))


def parse_items(text: Column) -> Column:
    """array<struct<id, user, first, reply>> of a writer's answer: a whole JSON text or the part from its first to its last brace; items without a user's text go, and of equal ids the last stays."""
    item = "struct<id: string, user: string, first: string, reply: string>"

    def items(s: Column) -> Column:
        return F.when(F.trim(s).startswith("["), F.from_json(s, f"array<{item}>")).otherwise(F.from_json(s, f"items array<{item}>")["items"])

    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    found = F.coalesce(items(text), items(F.when(inner != "", inner)), F.array().cast(f"array<{item}>"))
    kept = let(found, lambda xs: F.filter(xs, lambda x: x.isNotNull() & (F.coalesce(x["user"], F.lit("")) != "")))
    return let(kept, lambda xs: F.filter(xs, lambda x, i: ~F.exists(F.slice(xs, i + 2, F.greatest(F.size(xs), F.lit(1))), lambda y: y["id"].eqNullSafe(x["id"]))))


def make_records(seeds: DataFrame, items: DataFrame, seed: int = 0) -> DataFrame:
    """Records of the seeds that items (id, user, first, reply) were written for.

    A share of the records loses its diacritics, string arguments with it; a share gets a slip, which leaves digits and
    arguments' words alone. Rows without a user's text go, and follow-ups without a first one.
    """
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    rows = seeds.join(items.select("id", strip(F.col("user")).alias("user_raw"), strip(F.col("first")).alias("first_raw"), "reply"), "id")
    rows = rows.where((F.col("user_raw") != "") & ((F.col("scenario") != "followup") | (F.col("first_raw") != "")))
    bare, slip = unit(seed, F.col("id"), "bare") < NO_DIACRITICS, unit(seed, F.col("id"), "typo") < TYPO
    rows = rows.withColumn("bare", bare).withColumn("slip", slip)
    values = F.flatten(F.transform("calls", lambda c: F.transform(F.filter(F.map_values(c["arguments"]), lambda v: kind(v) == "str"), as_text)))
    protected = F.flatten(F.transform(values, lambda v: F.split(fold(v), r"\s+")))
    plain = F.when(F.col("bare"), fold(F.col("user_raw"))).otherwise(F.col("user_raw"))
    rows = rows.withColumn("user", F.when(F.col("slip"), add_typo(plain, unit(seed, F.col("id"), "slip").cast("string"), protected)).otherwise(plain))
    gold = gold_action(F.col("user"), F.col("reply"))
    folded = lambda m: F.transform_values(m, lambda k, v: F.when(kind(v) == "str", F.parse_json(F.to_json(fold(as_text(v)).cast("variant")))).otherwise(v))
    calls = lambda g: F.transform(g["calls"], lambda c: F.struct(c["name"].alias("name"), folded(c["arguments"]).alias("arguments"))).cast(CALLS)
    right = let(gold, lambda g: F.when(F.col("bare") & (g["kind"] == "call"), action(g["kind"], calls(g), g["text"])).otherwise(g))
    first = F.when(F.col("bare"), fold(F.col("first_raw"))).otherwise(F.col("first_raw"))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    none = F.array().cast("array<struct<role: string, content: string>>")
    history = F.when(F.col("scenario") == "followup", F.array(turn("user", first), turn("assistant", ask_text(F.element_at("calls", 1)["name"], F.col("omitted"))))).otherwise(none)
    style = F.concat(F.col("style"), F.when(F.col("bare"), F.lit("+no_diacritics")).otherwise(F.lit("")), F.when(F.col("slip"), F.lit("+typo")).otherwise(F.lit("")))
    return rows.select("id", "group", "scenario", style.alias("style"), "state", history.alias("history"), "user", right.alias("gold"), F.struct("calls", "omitted", "omitted_value", "topic").alias("seed"), "user_raw", "first_raw")
