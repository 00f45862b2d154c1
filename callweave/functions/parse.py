"""Model output to actions: lenient JSON, tool-call blocks, messages with separate tool calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import action
from .text import classify_text, let, once
from .values import CALL, CALLS, arguments_of, as_text, kind

BARE_NOTE = "json trần, không có <tool_call>"
NOT_A_CALL_NOTE = "json không đúng dạng tool call"
_EDGES = r"^\s+|\s+$"


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, _EDGES, "")


@once
def load_json(s: Column) -> Column:
    """The text of the first JSON value: code fences go, then what precedes the first brace or bracket unless the whole is JSON; null if that is no value."""
    bare = stripped(F.regexp_replace(F.regexp_replace(stripped(s), r"^```(?:json)?\s*", ""), r"\s*```$", ""))

    def of_start(start: Column) -> Column:
        return F.when(start == "", F.lit(None).cast("string")).when(F.try_parse_json(start).isNotNull() | (start.startswith("{") & F.from_json(start, "map<string,string>").isNotNull()), start)

    def of_bare(b: Column) -> Column:
        scalar = b.rlike(r'^("|-?[0-9]|true|false|null)') & F.try_parse_json(b).isNotNull()
        return F.when(scalar, b).otherwise(let(F.regexp_extract(b, r"(?s)[\{\[].*$", 0), of_start))

    return let(bare, of_bare)


def _call(json: Column) -> Column:
    """The call in an object's JSON text, or null: a nested function, arguments or parameters, an object or its JSON text."""

    def of(x: Column) -> Column:
        kinds, texts = x["kinds"], x["texts"]
        value = lambda k: F.try_element_at(kinds, F.lit(k))
        has = F.map_contains_key(kinds, F.lit("arguments"))
        field = F.when(has, value("arguments")).otherwise(value("parameters"))
        text = F.when(has, F.try_element_at(texts, F.lit("arguments"))).otherwise(F.try_element_at(texts, F.lit("parameters")))
        absent = ~has & ~F.map_contains_key(kinds, F.lit("parameters"))
        k = kind(field)
        empty = F.create_map().cast("map<string,variant>")
        args = (
            F.when(absent, empty)
            .when(k == "dict", arguments_of(text))
            .when((k == "str") & (stripped(as_text(field)) == ""), empty)
            .when(k == "str", let(load_json(as_text(field)), lambda t: F.when(t.startswith("{"), arguments_of(t))))
        )

        def named(y: Column) -> Column:
            good = (kind(y["name"]) == "str") & (as_text(y["name"]) != "") & y["args"].isNotNull()
            return F.when(F.coalesce(good, F.lit(False)), F.struct(as_text(y["name"]).alias("name"), y["args"].alias("arguments")).cast(CALL))

        return let(F.struct(value("name").alias("name"), args.alias("args")), named)

    def maps(s: Column) -> Column:
        return F.struct(F.from_json(s, "map<string,variant>").alias("kinds"), F.from_json(s, "map<string,string>").alias("texts"))

    nested = lambda x: kind(F.try_element_at(x["kinds"], F.lit("function"))) == "dict"
    inner = let(maps(json), lambda x: F.when(nested(x), maps(F.try_element_at(x["texts"], F.lit("function")))).otherwise(x))
    return F.when(json.startswith("{"), let(inner, of))


@once
def calls_from(json: Column) -> Column:
    """The calls in the JSON text of an object or an array of objects; null if there is none or one is not a call."""
    items = F.when(json.startswith("["), F.from_json(json, "array<string>")).when(json.startswith("{"), F.array(json))
    return let(F.transform(items, _call), lambda cs: F.when((F.size(cs) > 0) & F.forall(cs, lambda c: c.isNotNull()), cs))


@once
def parse_output(raw: Column) -> Column:
    """The action in a model's output.

    Thoughts and end tokens go. Calls are those in tool-call blocks, the last of which may lack its end; blocks that are no
    calls make the format invalid. Without blocks, a text that begins as JSON is calls if it can be, else an invalid
    format; any other text is told a question, refusal or reply.
    """
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?s)<think>.*?</think>", "")
    text = stripped(F.regexp_replace(stripped(F.regexp_replace(text, r"</?think>", "")), r"<\|im_end\|>|<\|endoftext\|>", ""))

    def of_text(t: Column) -> Column:
        closed = F.regexp_extract_all(t, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), 1)
        left = F.when(F.contains(t, F.lit("<tool_call>")), F.regexp_replace(t, r"(?s)<tool_call>.*?</tool_call>", "")).otherwise(t)

        def of_left(rest: Column) -> Column:
            more = F.contains(rest, F.lit("<tool_call>"))
            open_ = F.when(more, F.array(F.regexp_extract(rest, r"(?s)<tool_call>(.*)$", 1))).otherwise(F.array().cast("array<string>"))
            return F.struct(F.concat(closed, open_).alias("blocks"), stripped(F.when(more, F.regexp_replace(rest, r"(?s)<tool_call>.*$", "")).otherwise(rest)).alias("rest"))

        return let(left, of_left)

    def of_parts(x: Column) -> Column:
        rest = x["rest"]

        def of_blocks(parsed: Column) -> Column:
            bad = F.size(F.filter(parsed, lambda p: p.isNull()))
            calls = F.flatten(F.filter(parsed, lambda p: p.isNotNull()))
            notes = F.when(bad > 0, F.array(F.concat(bad.cast("string"), F.lit(" tool_call không parse được")))).otherwise(F.array().cast("array<string>"))
            return action(F.lit("call"), calls, rest, bad == 0, notes, raw)

        bare = let(F.struct(calls_from(load_json(rest)).alias("c")), lambda c: F.when(c["c"].isNotNull(), action(F.lit("call"), c["c"], F.lit(""), F.lit(True), F.array(F.lit(BARE_NOTE)), raw)).otherwise(action(classify_text(rest), None, rest, F.lit(False), F.array(F.lit(NOT_A_CALL_NOTE)), raw)))
        return (
            F.when(F.size(x["blocks"]) > 0, let(F.transform(x["blocks"], lambda b: calls_from(load_json(b))), of_blocks))
            .when(rest.rlike(r"^(\{|\[|```)"), bare)
            .otherwise(action(classify_text(rest), None, rest, None, None, raw))
        )

    return let(let(text, of_text), of_parts)


@once
def from_openai_message(content: Column, tool_calls: Column) -> Column:
    """The action in a message: its tool calls (an array of JSON texts) if it has any, else what its content says."""
    content = F.coalesce(content, F.lit(""))

    def of(calls: Column) -> Column:
        ok = F.filter(calls, lambda c: c.isNotNull())
        bad = F.size(calls) - F.size(ok)
        notes = F.when(bad > 0, F.array(F.concat(bad.cast("string"), F.lit(" tool_call không parse được")))).otherwise(F.array().cast("array<string>"))
        return action(F.lit("call"), ok, stripped(content), bad == 0, notes, content)

    return F.when(F.coalesce(F.size(tool_calls), F.lit(0)) > 0, let(F.transform(tool_calls, _call), of)).otherwise(parse_output(content))


def action_from_json(json: Column) -> Column:
    """An action from its JSON text: missing calls, text and notes are empty, null arguments too, and the format is valid unless said otherwise."""
    schema = "kind string, calls array<struct<name: string, arguments: string>>, text string, valid_format boolean, notes array<string>"

    def of(x: Column) -> Column:
        empty = F.create_map().cast("map<string,variant>")
        calls = F.transform(F.coalesce(x["calls"], F.array().cast("array<struct<name: string, arguments: string>>")), lambda c: F.struct(c["name"].alias("name"), F.coalesce(arguments_of(c["arguments"]), empty).alias("arguments")).cast(CALL))
        return action(x["kind"], calls.cast(CALLS), F.coalesce(x["text"], F.lit("")), F.coalesce(x["valid_format"], F.lit(True)), F.coalesce(x["notes"], F.array().cast("array<string>")))

    return let(F.from_json(json, schema), of)


@once
def action_to_json(act: Column) -> Column:
    """An action's JSON text; a valid format and empty notes are left out."""
    fields = F.struct(act["kind"].alias("kind"), act["calls"].alias("calls"), act["text"].alias("text"), F.when(~act["valid_format"], F.lit(False)).alias("valid_format"), F.when(F.size(act["notes"]) > 0, act["notes"]).alias("notes"))
    return F.to_json(fields)
