"""Predictions of a model over records: the model's calls are the one step in Python, behind a factory of clients.

A backend is any object with generate(messages, tools, max_tokens, temperature) giving a `Generated`; messages and tools
are plain Python. A factory makes one for each task. Parsing and guarding are expressions over its answers.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import from_openai_message
from ..functions.registry import openai_tools
from ..functions.rules import action, guard_action
from .chat import SYSTEM, build_messages, to_api_messages
from .storage import ship, stored


@dataclass
class Generated:
    text: str = ""
    tool_calls: list[dict] = field(default_factory=list)
    prompt_tokens: int = 0
    completion_tokens: int = 0


class Backend(Protocol):
    def generate(self, messages: list[dict], tools: list[dict], max_tokens: int, temperature: float) -> Generated: ...


class Scripted:
    """A backend that answers by the last message's text; a missing answer is an error."""

    def __init__(self, answers: dict[str, str], latency_s: float = 0.0):
        self.answers, self.latency_s = answers, latency_s

    def generate(self, messages: list[dict], tools: list[dict], max_tokens: int, temperature: float) -> Generated:
        time.sleep(self.latency_s)
        text = self.answers[messages[-1]["content"].split("</xe>\n", 1)[-1]]
        return Generated(text, [], sum(len(m["content"] or "") for m in messages), len(text))


class ChatServer:
    """A chat-completions server; post(url, body, headers) gives its decoded answer."""

    def __init__(self, base_url: str, model: str, post: Callable[[str, dict, dict], dict], api_key: str | None = None, extra_body: dict | None = None):
        self.base_url, self.model, self.post, self.api_key, self.extra_body = base_url.rstrip("/"), model, post, api_key, extra_body or {}

    def generate(self, messages: list[dict], tools: list[dict], max_tokens: int, temperature: float) -> Generated:
        body = {"model": self.model, "messages": messages, "tools": tools, "temperature": temperature, "max_tokens": max_tokens, **self.extra_body}
        answer = self.post(f"{self.base_url}/chat/completions", body, {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        said, usage = answer["choices"][0]["message"], answer.get("usage") or {}
        return Generated(said.get("content") or "", said.get("tool_calls") or [], usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0))


_ANSWER = "id string, content string, tool_calls array<string>, error string, latency_s double, prompt_tokens int, completion_tokens int"


def generated(records: DataFrame, factory: Callable[[], Backend], system: str = SYSTEM, tool_names: list[str] | None = None, max_tokens: int = 256, temperature: float = 0.0) -> DataFrame:
    """The backend's answers to records (id, user, state, history): a failing call gives its error and the rest goes on."""
    ship(records.sparkSession)
    tools = openai_tools(tool_names)
    names = [c.split()[0] for c in _ANSWER.split(", ")]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.float64(), pa.int32(), pa.int32()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = factory()
        for b in it:
            rows = []
            for key, messages in zip(*(c.to_pylist() for c in b.columns), strict=True):
                began, got, error = time.perf_counter(), Generated(), None
                try:
                    got = backend.generate(json.loads(messages), tools, max_tokens, temperature)
                except Exception as e:  # a failing model call must not end the run
                    error = str(e)[:200]
                calls = [json.dumps(c, ensure_ascii=False) for c in got.tool_calls]
                rows.append((key, got.text, calls, error, round(time.perf_counter() - began, 3), got.prompt_tokens, got.completion_tokens))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    messages = F.to_json(to_api_messages(build_messages(F.col("user"), F.col("state"), F.col("history"), system)))
    return records.select("id", messages.alias("messages")).mapInArrow(run, _ANSWER)


def _answered(records: DataFrame, factory: Callable[[], Backend], guard: bool, options: dict) -> DataFrame:
    """records with pred, pred_guarded and the answers' columns.

    A failed call is a reply of invalid format with a note. A record's `confirmed`, if there is such a column, tells the guard
    that the user has just confirmed. The answers are stored before they are read, so that no model is called twice.
    """
    answers = stored(generated(records, factory, **options), "answers")
    failed = action(F.lit("reply"), None, F.lit(""), F.lit(False), F.array(F.concat(F.lit("lỗi: "), F.coalesce("error", F.lit("")))))
    pred = F.when(F.col("error").isNotNull(), failed).otherwise(from_openai_message(F.col("content"), F.col("tool_calls")))
    rate = F.when(F.col("latency_s") > 0, F.round(F.col("completion_tokens") / F.col("latency_s"), 1)).otherwise(F.lit(0.0))
    rows = records.join(answers, "id").withColumn("pred", pred).withColumn("tokens_per_s", rate)
    confirmed = F.coalesce(F.col("confirmed"), F.lit(False)) if "confirmed" in records.columns else None
    return rows.withColumn("pred_guarded", guard_action(F.col("pred"), F.col("state"), confirmed) if guard else F.col("pred"))


def predict(records: DataFrame, factory: Callable[[], Backend], system: str, dataset: str, **options) -> DataFrame:
    """id, system, dataset, scenario, user, gold, pred, pred_guarded, raw, latency_s, prompt_tokens, completion_tokens, tokens_per_s for each record."""
    rows = _answered(records, factory, True, options)
    return rows.select("id", F.lit(system).alias("system"), F.lit(dataset).alias("dataset"), F.coalesce("scenario", F.lit("?")).alias("scenario"), "user", "gold", "pred", "pred_guarded", F.col("content").alias("raw"), "latency_s", "prompt_tokens", "completion_tokens", "tokens_per_s")


def decide(records: DataFrame, factory: Callable[[], Backend], guard: bool = True, **options) -> DataFrame:
    """id, action, meta (backend, latency_s, prompt_tokens, completion_tokens, tokens_per_s) for each request (id, user, state, history; confirmed if the user has just confirmed)."""
    rows = _answered(records, factory, guard, options)
    meta = F.struct(F.lit(getattr(factory, "__name__", type(factory).__name__)).alias("backend"), "latency_s", "prompt_tokens", "completion_tokens", "tokens_per_s")
    return rows.select("id", F.col("pred_guarded").alias("action"), meta.alias("meta"))
