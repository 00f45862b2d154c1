"""Validation of calls against the tools' schemas, safety rules over the vehicle's state, and the guard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import registry as R
from .text import let, once
from .values import CALL, CALLS, as_double, as_text, is_number, kind, quoted, spelled

# Limits and messages of the safety rules.
WINDOW_SPEED, WINDOW_PERCENT = 80, 50
UNCLEAR = "Mình chưa rõ yêu cầu, bạn nói lại giúp mình được không?"
STATE = "struct<speed_kmh: double, gear: string, is_night: boolean, battery_pct: int, range_km: int, doors_locked: boolean, cabin_temp_c: double, outside_temp_c: double>"
ACTION = f"struct<kind: string, calls: {CALLS}, text: string, valid_format: boolean, notes: array<string>, raw: string>"
_STATE_DEFAULTS = {"speed_kmh": 0.0, "gear": "P", "is_night": False, "battery_pct": 80, "range_km": None, "doors_locked": True, "cabin_temp_c": None, "outside_temp_c": None}
_STATE_TYPES = {"speed_kmh": "double", "gear": "string", "is_night": "boolean", "battery_pct": "int", "range_km": "int", "doors_locked": "boolean", "cabin_temp_c": "double", "outside_temp_c": "double"}


def state_of(fields: dict[str, Column] | None = None) -> Column:
    """A vehicle state; what is missing or null has its default."""
    own = fields or {}
    return F.struct(*(F.coalesce(*([own[k].cast(t)] if k in own else []), F.lit(_STATE_DEFAULTS[k]).cast(t)).alias(k) for k, t in _STATE_TYPES.items()))


def state_from_json(json: Column) -> Column:
    """The state in a JSON text: unknown keys are dropped, missing ones have their default; null and empty texts are the default state."""
    return let(F.from_json(json, ", ".join(f"{k} {t}" for k, t in _STATE_TYPES.items())), lambda s: state_of({k: s[k] for k in _STATE_TYPES}))


def moving(state: Column) -> Column:
    return state["speed_kmh"] > 0


@once
def render_state(state: Column) -> Column:
    """The state as a sentence; optional parts are left out where they are null."""
    reach = F.when(state["range_km"].isNotNull(), F.concat(F.lit(" (còn ~"), state["range_km"].cast("string"), F.lit(" km)"))).otherwise(F.lit(""))
    return F.concat_ws(
        "; ",
        F.concat(F.lit("tốc độ "), spelled(state["speed_kmh"]), F.lit(" km/h")),
        F.concat(F.lit("số "), state["gear"]),
        F.when(state["is_night"], F.lit("ban đêm")).otherwise(F.lit("ban ngày")),
        F.concat(F.lit("pin "), state["battery_pct"].cast("string"), F.lit("%"), reach),
        F.when(state["doors_locked"], F.lit("cửa đã khoá")).otherwise(F.lit("cửa chưa khoá")),
        F.concat(F.lit("trong xe "), spelled(state["cabin_temp_c"]), F.lit("°C")),
        F.concat(F.lit("ngoài trời "), spelled(state["outside_temp_c"]), F.lit("°C")),
    )


def _specs() -> Column:
    """tool.param to its schema."""
    kind_of = "struct<type: string, enum: array<string>, minimum: double, maximum: double, min_length: int, low: string, high: string>"
    items = []
    for t in R.TOOLS:
        for p in t.params:
            spec = F.struct(F.lit(p.type), R.literal(p.enum), F.lit(p.minimum).cast("double"), F.lit(p.maximum).cast("double"), F.lit(p.min_length).cast("int"), F.lit(str(p.minimum)), F.lit(str(p.maximum)))
            items += [F.lit(f"{t.name}.{p.name}"), spec.cast(kind_of)]
    return F.create_map(*items)


def type_ok(v: Column, type_: Column) -> Column:
    """Whether a value is of a schema's type; booleans are neither integer nor number. An unknown type is an error."""
    k = kind(v)
    return (
        F.when(type_ == "integer", k == "int")
        .when(type_ == "number", k.isin("int", "float"))
        .when(type_ == "string", k == "str")
        .when(type_ == "boolean", k == "bool")
        .when(type_ == "object", k == "dict")
        .when(type_ == "array", k == "list")
        .otherwise(F.raise_error(F.concat(F.lit("unsupported type: "), F.coalesce(type_, F.lit("null")))).cast("boolean"))
    )


@once
def _value_errors(path: Column, v: Column, spec: Column) -> Column:
    """Errors of one value; a wrong type is the only one."""
    listed = F.concat(F.lit("['"), F.array_join(spec["enum"], "', '"), F.lit("']"))
    number = as_double(v)
    found = F.array(
        F.when((F.size(spec["enum"]) > 0) & ~F.coalesce(F.array_contains(spec["enum"], as_text(v)), F.lit(False)), F.concat(path, F.lit(": "), quoted(v), F.lit(" không thuộc "), listed)),
        F.when(is_number(v) & (number < spec["minimum"]), F.concat(path, F.lit(": "), quoted(v), F.lit(" < "), spec["low"])),
        F.when(is_number(v) & (number > spec["maximum"]), F.concat(path, F.lit(": "), quoted(v), F.lit(" > "), spec["high"])),
        F.when((kind(v) == "str") & (F.length(F.regexp_replace(as_text(v), r"^\s+|\s+$", "")) < spec["min_length"]), F.concat(path, F.lit(": chuỗi rỗng"))),
    )
    wrong = F.array(F.concat(path, F.lit(": cần kiểu "), spec["type"], F.lit(", nhận "), kind(v)))
    return F.when(~type_ok(v, spec["type"]), wrong).otherwise(F.array_compact(found))


@once
def validate_call(name: Column, arguments: Column) -> Column:
    """The schema errors of a call, missing required arguments first, then in order of the arguments; none if it is valid."""
    specs = _specs()
    required = F.coalesce(R.lookup({t.name: R.literal(t.required) for t in R.TOOLS}, name), F.array().cast("array<string>"))
    missing = F.transform(F.filter(required, lambda k: ~F.map_contains_key(arguments, k)), lambda k: F.concat(name, F.lit(": thiếu '"), k, F.lit("'")))
    path = lambda k: F.concat(name, F.lit("."), k)
    own = F.flatten(
        F.transform(
            F.map_entries(arguments),
            lambda e: let(
                F.try_element_at(specs, path(e["key"])),
                lambda spec: F.when(spec.isNull(), F.array(F.concat(name, F.lit(": tham số lạ '"), e["key"], F.lit("'")))).otherwise(_value_errors(path(e["key"]), e["value"], spec)),
            ),
        )
    )
    unknown = F.array(F.concat(F.lit("tool không tồn tại: "), F.coalesce(name, F.lit("None"))))
    no_object = F.array(F.concat(name, F.lit(": cần kiểu object, nhận NoneType")))
    return F.when(~F.coalesce(name.isin(*R.TOOL_NAMES), F.lit(False)), unknown).when(arguments.isNull(), no_object).otherwise(F.concat(missing, own))


@once
def validate_variant(name: Column, arguments: Column) -> Column:
    """validate_call for arguments of any kind, as a variant; an object's keys are in ascending order."""
    wrong = F.array(F.concat(name, F.lit(": cần kiểu object, nhận "), kind(arguments)))
    known = F.coalesce(name.isin(*R.TOOL_NAMES), F.lit(False))
    return F.when(known & (kind(arguments) != "dict"), wrong).otherwise(validate_call(name, F.coalesce(arguments.try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))))


def validate(v: Column, schema: dict, path: str | Column = "$") -> Column:
    """The errors of a value (a variant) against a JSON schema of types, enum, minimum, maximum, minLength, properties, required and items, nested to any depth, each with its path; none if it is valid.

    A wrong type is a value's only error. An object's missing keys come first, then its own in ascending order; keys that
    the schema does not have are errors.
    """
    path = F.lit(path) if isinstance(path, str) else path
    type_ = schema.get("type")
    error = lambda *rest: F.concat(path, *rest)
    none = F.array().cast("array<string>")

    def of(x: Column) -> Column:
        number, text = as_double(x), as_text(x)
        found = []
        if "enum" in schema:
            known = F.lit(False)
            for e in schema["enum"]:
                same = (kind(x) == "str") & (text == e) if isinstance(e, str) else (kind(x) == "bool") & (text == str(e).lower()) if isinstance(e, bool) else is_number(x) & (number == float(e))
                known = known | F.coalesce(same, F.lit(False))
            found.append(F.when(~known, error(F.lit(": "), quoted(x), F.lit(f" không thuộc {schema['enum']}"))))
        if type_ in ("integer", "number"):
            if "minimum" in schema:
                found.append(F.when(number < schema["minimum"], error(F.lit(": "), quoted(x), F.lit(f" < {schema['minimum']}"))))
            if "maximum" in schema:
                found.append(F.when(number > schema["maximum"], error(F.lit(": "), quoted(x), F.lit(f" > {schema['maximum']}"))))
        if type_ == "string" and schema.get("minLength"):
            found.append(F.when(F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) < schema["minLength"], error(F.lit(": chuỗi rỗng"))))
        out = F.array_compact(F.array(*found)) if found else none
        if type_ == "object":
            out = F.concat(out, let(x.try_cast("map<string,variant>"), of_object))
        if type_ == "array" and "items" in schema:
            each = F.transform(x.try_cast("array<variant>"), lambda e, i: validate(e, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            out = F.concat(out, F.coalesce(F.flatten(each), none))
        return out

    def of_object(fields: Column) -> Column:
        known = schema.get("properties", {})
        missing = [F.when(~F.map_contains_key(fields, F.lit(k)), error(F.lit(f": thiếu '{k}'"))) for k in schema.get("required", [])]

        def one(e: Column) -> Column:
            out = None
            for k, inner in known.items():
                own = validate(e["value"], inner, error(F.lit(f".{k}")))
                out = F.when(e["key"] == k, own) if out is None else out.when(e["key"] == k, own)
            strange = F.array(error(F.lit(": tham số lạ '"), e["key"], F.lit("'")))
            return strange if out is None else out.otherwise(strange)

        own = F.flatten(F.transform(F.array_sort(F.map_entries(fields), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), one))
        return F.coalesce(F.concat(F.array_compact(F.array(*missing)) if missing else none, own), none)

    if type_ is None:
        return let(v, of)
    wrong = F.array(error(F.lit(f": cần kiểu {type_}, nhận "), kind(v)))
    return let(v, lambda x: F.when(~type_ok(x, F.lit(type_)), wrong).otherwise(of(x)))


def _verdict(decision: str, rule: str, message: Column) -> Column:
    return F.struct(F.lit(decision).alias("decision"), F.lit(rule).alias("rule"), message.alias("message"))


@once
def check_call(name: Column, arguments: Column, state: Column) -> Column:
    """struct<decision, rule, message> of one call: allow, refuse or confirm."""
    mode, percent = F.try_element_at(arguments, F.lit("mode")), F.try_element_at(arguments, F.lit("percent"))
    given = F.coalesce(F.map_contains_key(arguments, F.lit("percent")), F.lit(False))
    opened = F.when(~given, F.lit(100.0)).when(is_number(percent), as_double(percent)).when(kind(percent) == "bool", (as_text(percent) == "true").cast("double"))
    off = F.coalesce((kind(mode) == "str") & (as_text(mode) == "off"), F.lit(False))
    speed = F.lit("{speed}")  # put in last, so that it is spelled in one place
    unlock = F.concat(F.lit("Xe đang chạy "), speed, F.lit(" km/h, mở khoá cửa lúc này không an toàn. Bạn dừng hẳn xe rồi mình mở nhé."))
    lights = F.lit("Trời tối mà xe đang chạy, tắt đèn lúc này không an toàn nên mình giữ đèn bật.")
    window = F.concat(F.lit("Xe đang chạy "), speed, F.lit(" km/h, mở cửa sổ "), spelled(opened), F.lit("% sẽ rất ồn và gió mạnh. Bạn chắc chắn muốn mở chứ?"))
    found = (
        F.when((name == "unlock_doors") & moving(state), _verdict("refuse", "unlock_while_moving", unlock))
        .when((name == "set_lights") & off & state["is_night"] & moving(state), _verdict("refuse", "lights_off_at_night", lights))
        .when((name == "open_window") & (state["speed_kmh"] > WINDOW_SPEED) & (opened >= WINDOW_PERCENT), _verdict("confirm", "window_high_speed", window))
        .otherwise(_verdict("allow", "", F.lit("")))
    )
    with_speed = lambda v: F.when(F.contains(v["message"], speed), F.replace(v["message"], speed, spelled(state["speed_kmh"]))).otherwise(v["message"])
    return let(found, lambda v: F.struct(v["decision"].alias("decision"), v["rule"].alias("rule"), with_speed(v).alias("message")))


@once
def check_calls(calls: Column, state: Column) -> Column:
    """The worst verdict: the first refusal, else the first confirmation, else allow."""
    first = lambda vs, d: F.try_element_at(F.filter(vs, lambda v: v["decision"] == d), F.lit(1))
    return let(F.transform(calls, lambda c: check_call(c["name"], c["arguments"], state)), lambda vs: F.coalesce(first(vs, "refuse"), first(vs, "confirm"), _verdict("allow", "", F.lit(""))))


def action(kind_: Column, calls: Column | None = None, text: Column | None = None, valid_format: Column | None = None, notes: Column | None = None, raw: Column | None = None) -> Column:
    """An action; what is not given is empty, and its format valid."""
    return F.struct(
        kind_.alias("kind"),
        (F.array().cast(CALLS) if calls is None else calls).alias("calls"),
        (F.lit("") if text is None else text).alias("text"),
        (F.lit(True) if valid_format is None else valid_format).alias("valid_format"),
        (F.array().cast("array<string>") if notes is None else notes).alias("notes"),
        (F.lit("") if raw is None else raw).alias("raw"),
    )


def guard_action(act: Column, state: Column, confirmed: Column | None = None) -> Column:
    """`_guarded`, unconfirmed unless said otherwise."""
    return _guarded(act, state, F.lit(False) if confirmed is None else confirmed)


@once
def _guarded(act: Column, state: Column, confirmed: Column) -> Column:
    """The action after the guard.

    Calls with schema errors go, with a note each; without one left it asks. A refusal, or a confirmation not yet given,
    replaces the action. What is not a call, or passes whole, is unchanged.
    """
    judged = F.transform(act["calls"], lambda c: F.struct(c.alias("call"), validate_call(c["name"], c["arguments"]).alias("errors")))

    def decide(x: Column) -> Column:
        valid = F.transform(F.filter(x, lambda j: F.size(j["errors"]) == 0), lambda j: j["call"])
        bad = F.filter(x, lambda j: F.size(j["errors"]) > 0)
        notes = F.concat(act["notes"], F.transform(bad, lambda j: F.concat(F.lit("guard bỏ lệnh sai schema: "), F.array_join(j["errors"], "; "))))

        def ruled(v: Column) -> Column:
            blocked = (v["decision"] == "refuse") | ((v["decision"] == "confirm") & ~confirmed)
            as_kind = F.when(v["decision"] == "refuse", F.lit("refuse")).otherwise(F.lit("ask"))
            instead = action(as_kind, None, v["message"], act["valid_format"], F.concat(notes, F.array(F.concat(F.lit("guard: "), v["rule"]))), act["raw"])
            return F.when(blocked, instead).when(F.size(bad) == 0, act).otherwise(action(F.lit("call"), valid, act["text"], act["valid_format"], notes, act["raw"]))

        unclear = action(F.lit("ask"), None, F.lit(UNCLEAR), act["valid_format"], notes, act["raw"])
        return F.when(F.size(valid) == 0, unclear).otherwise(let(check_calls(valid, state), ruled))

    return F.when(act["kind"] != "call", act).otherwise(let(judged, decide))


__all__ = ["ACTION", "CALL", "STATE", "action", "check_call", "check_calls", "guard_action", "render_state", "state_from_json", "state_of", "type_ok", "validate", "validate_call", "validate_variant"]
