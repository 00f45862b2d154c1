"""Preference pairs: typical errors made from right answers, a model's own errors, capped unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions.rules import action
from ..functions.text import let, once, pick, unit
from ..functions.values import CALLS, actions_match, as_double, as_text, kind
from .chat import assistant_message, message, record_messages

# Tools that are not there, tools taken for each other, a needless refusal.
FAKE_TOOLS = ("set_temperature", "turn_on_ac", "open_door", "call_phone", "play_song", "set_ac", "navigate", "unlock_car", "check_battery", "search_law", "set_fan", "volume_up")
CHITCHAT_FAKE_TOOLS = ("get_weather", "search_web", "book_ticket", "tell_joke")
CONFUSABLE = {
    "set_climate": ("set_fan_speed",),
    "set_fan_speed": ("set_climate",),
    "set_volume": ("play_music",),
    "play_music": ("set_volume",),
    "lock_doors": ("unlock_doors",),
    "unlock_doors": ("lock_doors", "open_window"),
    "navigate_to": ("find_charging_station",),
    "find_charging_station": ("navigate_to",),
    "lookup_traffic_law": ("lookup_sign",),
    "lookup_sign": ("lookup_traffic_law",),
    "open_window": ("unlock_doors",),
    "call_contact": ("read_messages",),
    "read_messages": ("call_contact",),
    "set_lights": ("set_drive_mode",),
    "set_drive_mode": ("set_lights",),
    "get_vehicle_status": ("find_charging_station",),
    "set_reminder": ("read_messages",),
}
OVER_REFUSE = "Xin lỗi, mình không thể làm việc này lúc xe đang chạy."
POOLS = {"destination": R.DESTINATIONS, "name": R.CONTACTS, "query": R.MUSIC, "text": R.REMINDERS, "code": R.SIGN_CODES}


def _as_variant(json: Column) -> Column:
    return F.parse_json(json)


def _json_text(s: Column) -> Column:
    return F.to_json(s.cast("variant"))


@once
def other_value(tool: Column, param: Column, value: Column, u: Column) -> Column:
    """Another value of a parameter, by chance: of its choices, its range or its pool; null if there is none."""
    choices, lows, highs = {}, {}, {}
    for t in R.TOOLS:
        for p in t.params:
            key = f"{t.name}.{p.name}"
            if p.enum:
                choices[key] = R.literal(p.enum)
            elif p.type == "string" and p.name in POOLS:
                choices[key] = R.literal(POOLS[p.name])
            elif p.type in ("integer", "number"):
                lows[key], highs[key] = int(p.minimum or 0), int(100 if p.maximum is None else p.maximum)
    path = F.concat(tool, F.lit("."), param)
    others = F.filter(R.lookup(choices, path), lambda x: ~x.eqNullSafe(as_text(value)))
    number = as_double(value)
    low, high = R.lookup(lows, path), R.lookup(highs, path)
    numbers = F.filter(F.sequence(F.coalesce(low, F.lit(0)), F.coalesce(high, F.lit(0))), lambda x: ~x.cast("double").eqNullSafe(number))
    return (
        F.when(F.size(others) > 0, _as_variant(_json_text(pick(others, u))))
        .when(kind(value) == "bool", _as_variant(F.when(as_text(value) == "true", F.lit("false")).otherwise(F.lit("true"))))
        .when(low.isNotNull() & (F.size(numbers) > 0), _as_variant(pick(numbers, u).cast("string")))
    )


@once
def wrong_unit(arguments: Column) -> Column:
    """Arguments with the first positive of temperature, level, percent times ten, else minutes of an hour or more as hours; null if neither is there."""
    get = lambda k: F.try_element_at(arguments, F.lit(k))
    put = lambda k, json: F.map_zip_with(arguments, F.create_map(F.lit(k), _as_variant(json)), lambda _, a, b: F.coalesce(b, a))
    spelled = lambda x: F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))
    out = None
    for k in ("temperature", "level", "percent"):
        grows = kind(get(k)).isin("int", "float") & (as_double(get(k)) > 0)
        out = (out.when if out is not None else F.when)(grows, put(k, spelled(as_double(get(k)) * 10)))
    hours = (kind(get("minutes")) == "int") & (as_double(get("minutes")) >= 60)
    return out.when(hours, put("minutes", F.floor(as_double(get("minutes")) / 60).cast("string")))


def perturbed(seed: int = 0) -> Column:
    """array<struct<type, action>>: the wrong answers that can be made from a record's row, less those that match its right one."""
    u = lambda purpose: unit(seed, F.col("id"), purpose)
    gold, own = F.col("gold"), F.col("seed")
    calls = gold["calls"]
    n = F.size(calls)
    call = lambda name, arguments: F.struct(name.alias("name"), arguments.alias("arguments"))
    variant = lambda kind_, cond, act: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(kind_).alias("type"), act.alias("action")))
    put = lambda m, k, v: F.map_zip_with(m, F.create_map(k, v), lambda _, a, b: F.coalesce(b, a))
    free = [f"{a}.{b}" for a, b in R.FREE_TEXT]
    at = F.floor(u("call") * n).cast("int") + 1
    picked = F.struct(at.alias("at"), F.try_element_at(calls, F.greatest(at, F.lit(1))).alias("c"))

    def with_slot(x: Column) -> Column:
        keys = F.filter(F.map_keys(x["c"]["arguments"]), lambda k: ~F.concat(x["c"]["name"], F.lit("."), k).isin(*free))
        return F.struct(x["at"].alias("at"), x["c"].alias("c"), pick(keys, u("key")).alias("key"))

    def with_values(x: Column) -> Column:
        c = x["c"]
        return F.struct(
            x["at"].alias("at"),
            c.alias("c"),
            x["key"].alias("key"),
            F.when(x["key"].isNotNull(), other_value(c["name"], x["key"], F.try_element_at(c["arguments"], x["key"]), u("value"))).alias("value"),
            wrong_unit(c["arguments"]).alias("scaled"),
            R.lookup({k: R.literal(v) for k, v in CONFUSABLE.items()}, c["name"]).alias("confusable"),
            F.coalesce(R.lookup({t.name: R.literal(t.required) for t in R.TOOLS}, c["name"]), F.array().cast("array<string>")).alias("required"),
        )

    def of_call(x: Column) -> Column:
        c = x["c"]
        with_call = lambda new: action(F.lit("call"), F.transform(calls, lambda y, i: F.when(i + 1 == x["at"], new).otherwise(y)).cast(CALLS))
        lost = pick(x["required"], u("lost"))
        return F.array(
            variant("wrong_tool", x["confusable"].isNotNull(), with_call(call(pick(x["confusable"], u("confusable")), c["arguments"]))),
            variant("hallucinated_tool", n > 0, with_call(call(pick(R.literal(FAKE_TOOLS), u("fake")), c["arguments"]))),
            variant("wrong_value", x["value"].isNotNull(), with_call(call(c["name"], put(c["arguments"], F.coalesce(x["key"], F.lit("")), x["value"])))),
            variant("wrong_unit", x["scaled"].isNotNull(), with_call(call(c["name"], x["scaled"]))),
            variant("missing_arg", F.size(x["required"]) > 0, with_call(call(c["name"], F.map_filter(c["arguments"], lambda k, v: k != lost)))),
            variant("dropped_call", n > 1, action(F.lit("call"), F.slice(calls, 1, 1))),
            variant("over_refuse", F.col("scenario") != "law", action(F.lit("refuse"), None, F.lit(OVER_REFUSE))),
        )

    seed_call = F.try_element_at(own["calls"], F.lit(1))
    has_seed = F.coalesce(F.size(own["calls"]), F.lit(0)) > 0
    slot = F.coalesce(own["omitted"], F.lit(""))
    guess = F.coalesce(own["omitted_value"], other_value(seed_call["name"], own["omitted"], F.lit(None).cast("variant"), u("guess")))
    comply = action(F.lit("call"), own["calls"])
    fake = F.array(call(pick(R.literal(CHITCHAT_FAKE_TOOLS), u("fake")), F.create_map(F.lit("query"), _as_variant(_json_text(F.col("user")))))).cast(CALLS)
    of_ask = F.array(
        variant("guess_instead_of_ask", has_seed & (slot != ""), action(F.lit("call"), F.array(call(seed_call["name"], put(seed_call["arguments"], slot, guess))).cast(CALLS))),
        variant("skip_confirm", has_seed & (slot == ""), comply),
    )
    found = (
        F.when(gold["kind"] == "call", let(let(let(picked, with_slot), with_values), of_call))
        .when(gold["kind"] == "ask", of_ask)
        .when(gold["kind"] == "refuse", F.array(variant("comply_unsafe", has_seed, comply)))
        .when(gold["kind"] == "reply", F.array(variant("spurious_call", F.lit(True), action(F.lit("call"), fake))))
    )
    return F.filter(F.array_compact(found), lambda x: ~actions_match(gold, x["action"]))


def _pair(kind_: Column, rejected: Column) -> list[Column]:
    """A malformed answer is kept as text up to its end token."""
    raw = F.regexp_replace(rejected["raw"], r"(?s)(<\|im_end\|>|<\|endoftext\|>).*$", "")
    broken = ~rejected["valid_format"] & (F.coalesce(rejected["raw"], F.lit("")) != "")
    wrong = F.when(broken, message("assistant", raw)).otherwise(assistant_message(rejected))
    return [F.col("id"), kind_.alias("type"), record_messages(F.col("user"), F.col("state"), F.col("history")).alias("messages"), assistant_message(F.col("gold")).alias("chosen"), wrong.alias("rejected")]


def build_pairs(records: DataFrame, seed: int = 0, per_record: int = 1) -> DataFrame:
    """id, type, messages, chosen, rejected: per_record wrong answers of each record, by a hash, none twice."""
    rows = records.withColumn("wrong", perturbed(seed))
    chance = F.transform("wrong", lambda x: F.struct(unit(seed, F.col("id"), "take", x["type"]).alias("u"), x.alias("x")))
    taken = F.slice(F.array_sort(chance, lambda a, b: F.when(a["u"] < b["u"], -1).when(a["u"] > b["u"], 1).otherwise(0)), 1, per_record)
    return rows.withColumn("pick", F.explode(taken)).select(*_pair(F.col("pick.x.type"), F.col("pick.x.action")))


def mine_on_policy(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """Pairs of records and predictions (id, pred) that do not match or whose format is invalid; every record must have one prediction."""
    rows = records.join(predictions.select("id", "pred"), "id", "left")
    there = F.when(F.col("pred").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), F.col("id"))).cast("boolean")).otherwise(F.lit(True))
    wrong = ~actions_match(F.col("gold"), F.col("pred")) | ~F.col("pred.valid_format")
    return rows.where(there & wrong).select(*_pair(F.lit("on_policy"), F.col("pred")))


def capped_union(first: DataFrame, fill: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    """All of first and as much of fill, by a hash of its id, as makes cap rows; of first alone if it is larger."""
    both = first.withColumn("place", F.lit(0)).unionByName(fill.withColumn("place", F.lit(1)))
    return both.withColumn("u", unit(seed, F.col("id"), F.col("type"))).orderBy("place", "u", "id").limit(cap).drop("place", "u")


def shuffled(rows: DataFrame, key: Column, seed: int = 0) -> DataFrame:
    """Rows in an order by a hash of the seed and the key."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), key).cast("binary")), key)


def sampled(rows: DataFrame, key: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement: those of the least hashes."""
    return shuffled(rows, key, seed).limit(n)


def per_group(rows: DataFrame, group: Column, key: Column, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group, of the least hashes."""
    order = Window.partitionBy(group).orderBy(unit(seed, key), key)
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


__all__ = ["build_pairs", "capped_union", "mine_on_policy", "other_value", "per_group", "perturbed", "sampled", "shuffled", "wrong_unit"]
