"""A language model as a source of texts: one client with retries, waits and fallback models; batches over Spark."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.seeds import make_records, parse_items, prompts
from ..operators.storage import ship, stored

# Fixed value: the writer's instructions.
SYSTEM = """Bạn giúp tạo dữ liệu huấn luyện cho trợ lý giọng nói trên ô tô điện ở Việt Nam.
Với mỗi mục, hãy viết câu NGƯỜI DÙNG nói với trợ lý (đang ngồi trong xe), đúng yêu cầu và văn phong của mục đó.
Quy tắc:
- Chỉ viết lời người dùng, tiếng Việt tự nhiên như người thật nói, không giải thích.
- Phải nhắc ĐỦ các giá trị được cho (số, tên, địa điểm...), không thêm yêu cầu nào khác.
- Mỗi mục một câu khác nhau, đừng lặp lại cấu trúc câu giữa các mục.
- Số có thể viết bằng chữ số hoặc bằng chữ.
Trả về JSON: {"items": [{"id": "...", "user": "...", ...}]} theo đúng các trường mỗi mục yêu cầu."""


class WriterError(RuntimeError):
    """The request failed, or every model's daily quota is used up."""


@dataclass
class Answer:
    """What a transport gives: the status, the text of the body, and headers in lower case; status 0 is a network error."""

    status: int
    text: str = ""
    headers: dict[str, str] = field(default_factory=dict)

    @property
    def daily_limit(self) -> bool:
        low = self.text.lower()
        return self.status == 429 and (float(self.headers.get("retry-after") or 0) > 300 or any(s in low for s in ("per day", "(tpd)", "(rpd)")))


@dataclass
class Client:
    """complete(system, user): the text of send(model, system, user, temperature, json_mode)'s answer.

    A per-minute limit waits as told (120 s at most) and tries again; a daily limit goes on with the next model; other
    client errors end at once; server and network errors are tried again.
    """

    send: Callable[[str, str, str, float, bool], Answer]
    models: list[str]
    retries: int = 4
    sleep: Callable[[float], None] = time.sleep

    @property
    def model(self) -> str:
        return self.models[0]

    def complete(self, system: str, user: str, temperature: float = 0.9, json_mode: bool = True) -> str:
        while True:
            got = self._tried(system, user, temperature, json_mode)
            if got.status == 200:
                return got.text
            if not got.daily_limit:
                raise WriterError(f"{got.status}: {got.text[:200]}")
            if len(self.models) == 1:
                raise WriterError(f"daily quota of every model used up: {got.text[:200]}")
            self.models = self.models[1:]

    def _tried(self, system: str, user: str, temperature: float, json_mode: bool) -> Answer:
        for attempt in range(1, self.retries + 2):
            got = self.send(self.model, system, user, temperature, json_mode)
            if got.status == 200 or got.daily_limit or 400 <= got.status < 429 or 429 < got.status < 500:
                return got
            if got.status == 429:
                self.sleep(min(float(got.headers.get("retry-after") or 10 * attempt), 120))
            else:
                self.sleep(2 * attempt)
        return got


def written(seeds: DataFrame, factory: Callable[[], Callable[[str, str], str]], batch_size: int = 8) -> DataFrame:
    """batch, ids, text: the writer's answers to batches of seeds; a batch whose request fails has a null text and may be tried again."""

    ship(seeds.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        complete = factory()
        for b in it:
            texts: list[str | None] = []
            for prompt in b.column(2).to_pylist():
                try:
                    texts.append(complete(SYSTEM, prompt))
                except Exception:  # left for the next run
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["batch", "ids", "text"])

    return prompts(seeds, batch_size).select("batch", "ids", "prompt").mapInArrow(run, "batch long, ids array<string>, text string")


def generate(seeds: DataFrame, done: DataFrame | None, factory: Callable[[], Callable[[str, str], str]], seed: int = 0, batch_size: int = 8) -> DataFrame:
    """Records for the seeds whose ids are not in done (id)."""
    todo = seeds if done is None else seeds.join(done.select("id"), "id", "left_anti")
    answers = stored(written(todo, factory, batch_size), "written")
    items = answers.where(F.col("text").isNotNull()).select("ids", F.explode(parse_items(F.col("text"))).alias("x")).where(F.array_contains("ids", F.col("x.id"))).select("x.*")
    return make_records(todo, items, seed)
