"""Messages of a conversation with the assistant: building, rendering, splitting, and shapes that model servers take."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions.rules import render_state
from ..functions.text import let
from ..functions.values import CALLS

MESSAGE = f"struct<role: string, content: string, tool_calls: {CALLS}>"
# Fixed value: the assistant's instructions.
SYSTEM = """Bạn là trợ lý giọng nói trên ô tô điện. Mỗi lượt người dùng có kèm trạng thái xe trong thẻ <xe>.
- Đủ thông tin: gọi một hoặc nhiều hàm phù hợp, không nói thêm.
- Thiếu thông tin bắt buộc: hỏi lại đúng một câu ngắn.
- Yêu cầu không an toàn với trạng thái xe hiện tại: từ chối ngắn gọn và nêu lý do.
- Hỏi về luật giao thông hoặc biển báo: gọi lookup_traffic_law hoặc lookup_sign.
- Ngoài phạm vi: trả lời ngắn, thân thiện.
Chỉ dùng các hàm được cung cấp, đúng tên và đúng kiểu tham số."""


def message(role: str | Column, content: Column, tool_calls: Column | None = None) -> Column:
    none = F.lit(None).cast(CALLS)
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"), (none if tool_calls is None else tool_calls).alias("tool_calls"))


def user_turn(text: Column, state: Column) -> Column:
    """The user's text under the state's sentence."""
    return F.concat(F.lit("<xe>"), render_state(state), F.lit("</xe>\n"), F.regexp_replace(text, r"^\s+|\s+$", ""))


def build_messages(user: Column, state: Column, history: Column, system: str = SYSTEM) -> Column:
    """The system's message, earlier turns as they were, and the user's text with the state."""
    none = F.array().cast(f"array<{MESSAGE}>")
    earlier = F.transform(history, lambda m: message(m["role"], m["content"]))
    return F.concat(F.array(message("system", F.lit(system))), F.coalesce(earlier, none), F.array(message("user", user_turn(user, state))))


def assistant_message(act: Column) -> Column:
    """An action as a message; calls go with it if it is a call with any."""
    return message("assistant", act["text"], F.when((act["kind"] == "call") & (F.size(act["calls"]) > 0), act["calls"]))


def record_messages(user: Column, state: Column, history: Column, gold: Column | None = None, system: str = SYSTEM) -> Column:
    """A record's messages, with the right answer last if it is given."""
    own = build_messages(user, state, history, system)
    return own if gold is None else F.concat(own, F.array(assistant_message(gold)))


def _call_json(c: Column) -> Column:
    return F.concat(F.lit('{"name": '), F.to_json(c["name"].cast("variant")), F.lit(', "arguments": '), F.to_json(c["arguments"]), F.lit("}"))


@dataclass(frozen=True)
class Template:
    """How a model's messages are written: {role}, {tools} and {call} stand for a role's name, the tools' JSON and a call's."""

    begin: str = ""
    open: str = "<|im_start|>{role}\n"
    close: str = "<|im_end|>\n"
    roles: tuple[tuple[str, str], ...] = ()  # roles with another name in the text
    tools: str = "\n\n# Tools\n\n<tools>\n{tools}\n</tools>\n\nFor each function call, return a JSON object with function name and arguments within <tool_call></tool_call> tags."
    call: str = "<tool_call>\n{call}\n</tool_call>"
    thought: str = "<think>\n\n</think>\n\n"  # before each answer


CHATML = Template()


def render(messages: Column, template: Template = CHATML, tools_json: str | None = None, add_generation_prompt: bool = True) -> Column:
    """Messages as text by a template: tools are declared in the system's message, calls follow the content, and answers follow an empty thought."""
    names = dict(template.roles)
    role_of = lambda m: F.coalesce(*([R.lookup(names, m["role"])] if names else []), m["role"])

    def filled(form: str, mark: str, value: Column) -> Column:
        head, _, tail = form.partition(mark)
        return F.concat(F.lit(head), value, F.lit(tail)) if mark in form else F.lit(form)

    def one(m: Column) -> Column:
        calls = F.transform(m["tool_calls"], lambda c: filled(template.call, "{call}", _call_json(c)))
        body = F.concat_ws("\n", F.when((F.coalesce(m["content"], F.lit("")) != "") | m["tool_calls"].isNull(), F.coalesce(m["content"], F.lit(""))), calls)
        more = F.when(m["role"] == "system", F.lit("" if tools_json is None else template.tools.replace("{tools}", tools_json))).otherwise(F.lit(""))
        thought = F.when(m["role"] == "assistant", F.lit(template.thought)).otherwise(F.lit(""))
        return F.concat(filled(template.open, "{role}", role_of(m)), thought, body, more, F.lit(template.close))

    prompt = template.open.replace("{role}", names.get("assistant", "assistant")) + template.thought if add_generation_prompt else ""
    return F.concat(F.lit(template.begin), F.array_join(F.transform(messages, one), ""), F.lit(prompt))


def render_chatml(messages: Column, tools_json: str | None = None, add_generation_prompt: bool = True) -> Column:
    """Messages as ChatML text."""
    return render(messages, CHATML, tools_json, add_generation_prompt)


def render_jinja(messages: Column, template: str, tools: list[dict] | None = None, add_generation_prompt: bool = True, **values) -> Column:
    """Messages as text by a model's Jinja template, in Arrow batches; an ImportError where jinja2 is not installed."""
    import jinja2.ext
    import jinja2.sandbox

    def of(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        env = jinja2.sandbox.ImmutableSandboxedEnvironment(trim_blocks=True, lstrip_blocks=True, extensions=[jinja2.ext.loopcontrols])
        env.filters["tojson"] = lambda x, **how: json.dumps(x, **{"ensure_ascii": False, **how})
        form = env.from_string(template)
        for texts in rows:
            yield pd.Series([form.render(messages=json.loads(t), tools=tools, add_generation_prompt=add_generation_prompt, **values) for t in texts])

    of.__annotations__ = {"rows": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(of, "string")(F.to_json(to_api_messages(messages)))


def split_prompt_completion(messages: Column, render: Callable[[Column, bool], Column]) -> Column:
    """struct<prompt, completion>: all but the last message rendered with a generation prompt, and what the whole adds; an error if it does not begin so."""
    before = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))

    def split(x: Column) -> Column:
        wrong = F.raise_error(F.lit("chat template: the whole does not begin with the prompt")).cast("string")
        rest = F.when(x["whole"].startswith(x["prompt"]), F.substring(x["whole"], F.length(x["prompt"]) + 1, F.length(x["whole"]))).otherwise(wrong)
        return F.struct(x["prompt"].alias("prompt"), rest.alias("completion"))

    return let(F.struct(render(before, True).alias("prompt"), render(messages, False).alias("whole")), split)


def to_api_messages(messages: Column) -> Column:
    """Messages in the shape of chat-completion servers: calls have ids call_<message>_<call> and arguments as JSON text."""
    return F.transform(
        messages,
        lambda m, i: F.struct(
            m["role"].alias("role"),
            m["content"].alias("content"),
            F.when(
                F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0,
                F.transform(m["tool_calls"], lambda c, j: F.struct(F.concat(F.lit("call_"), i.cast("string"), F.lit("_"), j.cast("string")).alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), F.to_json(c["arguments"]).alias("arguments")).alias("function"))),
            ).alias("tool_calls"),
        ),
    )


def to_parts(messages: Column) -> Column:
    """struct<system, contents> in the shape of part-based servers: model and user turns of text and functionCall parts."""
    part = lambda text, call: F.struct(text.alias("text"), call.alias("functionCall"))
    call_type = "struct<name: string, args: map<string, variant>>"
    of_text = lambda m: F.array(part(m["content"], F.lit(None).cast(call_type)))

    def turn(m: Column) -> Column:
        said = F.when((m["role"] == "user") | (F.coalesce(m["content"], F.lit("")) != ""), of_text(m)).otherwise(F.array().cast(f"array<struct<text: string, functionCall: {call_type}>>"))
        calls = F.transform(F.coalesce(m["tool_calls"], F.array().cast(CALLS)), lambda c: part(F.lit(None).cast("string"), F.struct(c["name"].alias("name"), c["arguments"].alias("args")).cast(call_type)))
        return F.struct(F.when(m["role"] == "user", F.lit("user")).otherwise(F.lit("model")).alias("role"), F.concat(said, calls).alias("parts"))

    system = F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"])), -1)
    return F.struct(system.alias("system"), F.transform(F.filter(messages, lambda m: m["role"] != "system"), turn).alias("contents"))


def parts_schema(schema: dict) -> dict:
    """A parameter schema with the keys that part-based servers know, types in capitals."""
    known = ("type", "description", "enum", "properties", "required", "minimum", "maximum", "items")
    change = {"type": str.upper, "properties": lambda v: {k: parts_schema(x) for k, x in v.items()}, "items": parts_schema}
    return {k: change.get(k, lambda v: v)(v) for k, v in schema.items() if k in known}


def parts_tools(tools: list[dict]) -> list[dict]:
    """Function declarations for part-based servers; parameters are left out where there are none."""
    out = []
    for f in (t["function"] for t in tools):
        shape = {"parameters": parts_schema(f["parameters"])} if f["parameters"].get("properties") else {}
        out.append({"name": f["name"], "description": f["description"], **shape})
    return [{"functionDeclarations": out}]


def from_parts(response: Column) -> Column:
    """struct<content, tool_calls (JSON texts)> of a part-based server's JSON answer; thoughts go; no candidate is empty content."""
    schema = "candidates array<struct<content: struct<parts: array<struct<text: string, thought: boolean, functionCall: struct<name: string, args: string>>>>>>"
    parts = F.coalesce(F.try_element_at(F.from_json(response, schema)["candidates"], F.lit(1))["content"]["parts"], F.array().cast("array<struct<text: string, thought: boolean, functionCall: struct<name: string, args: string>>>"))
    text = F.array_join(F.transform(F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False)) & p["text"].isNotNull()), lambda p: p["text"]), "")
    calls = F.transform(F.filter(parts, lambda p: p["functionCall"].isNotNull()), lambda p: F.concat(F.lit('{"type":"function","function":{"name":'), F.to_json(p["functionCall"]["name"].cast("variant")), F.lit(',"arguments":'), F.coalesce(p["functionCall"]["args"], F.lit("{}")), F.lit("}}")))
    return F.struct(text.alias("content"), calls.alias("tool_calls"))


def token_rows(prompt_ids: Column, completion_ids: Column, longest: int) -> Column:
    """struct<input_ids, attention_mask, labels> with the prompt masked by -100; null if both are longer than longest."""
    ids = F.concat(prompt_ids, completion_ids)
    row = F.struct(ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"), F.concat(F.array_repeat(F.lit(-100), F.size(prompt_ids)), completion_ids).alias("labels"))
    return F.when(F.size(ids) <= longest, row)


def plan_steps(n: int, per_step: int, epochs: float, tokens_per_item: float, tokens_per_second: float, minutes: float) -> int:
    """Training steps: all epochs, or what fits the minutes if that is less; one at least."""
    all_epochs = -(-n * epochs // per_step)
    return max(1, int(min(all_epochs, minutes * 60 * tokens_per_second // (per_step * tokens_per_item))))


def planned_steps(n: Column, per_step: int, epochs: float, tokens_per_item: Column, tokens_per_second: float, minutes: float) -> Column:
    """plan_steps of columns."""
    whole = F.ceil(n * F.lit(float(epochs)) / per_step)
    fits = F.floor(F.lit(minutes * 60.0 * tokens_per_second) / (tokens_per_item * per_step))
    return F.greatest(F.lit(1).cast("long"), F.least(whole.cast("long"), fits.cast("long")))
