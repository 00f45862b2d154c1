"""Dataset building: record checks, duplicate removal, hash split, statistics, the build report.

A record is a row with id, group, scenario, style, state (rules.STATE), history array<struct<role, content>>, user, gold
(rules.ACTION), seed struct<calls, omitted, omitted_value variant, topic>, user_raw and first_raw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions.rules import check_calls, validate_call
from ..functions.text import alnum, classify_text, has_phrase, let, mentions_number, mostly_english, normalize, once, seed_hash, words
from ..functions.values import as_double, as_text, is_number, kind, quoted
from .dedup import dedupe
from .storage import stored

# Signs of a copied instruction, of a made-up deed, and of a Vietnamese reply.
LEAK = r"(^|[^\p{L}\p{N}_])((chua|khong) (noi|neu|cho biet))($|[^\p{L}\p{N}_])|nguoi dung|tro ly hoi"
ASSISTANT_START = "ban muon"
FAKE_DONE = ("đã xong", "đã đặt", "đã được đặt", "đã book", "xyz")
VIETNAMESE = "[à-ỹđ]"
LONGEST = 300
WITH_VALUES = ("single", "multi", "unsafe", "missing", "followup")


def _alias_map(table: dict) -> dict[str, Column]:
    out = {}
    for (tool, param), values in table.items():
        for value, phrases in values.items():
            spelled = str(value).lower() if isinstance(value, bool) else str(value)
            out[f"{tool}.{param}.{spelled}"] = R.literal(phrases)
    return out


@once
def mentions_value(text: Column, tool: Column, param: Column, value: Column) -> Column:
    """Whether a text says an argument's value, by the parameter: a phrase for it, the number, the sign's code, half a reminder's words, else all words."""
    path = F.concat(tool, F.lit("."), param)
    spelled = F.concat(path, F.lit("."), F.coalesce(F.when(is_number(value) & (as_double(value) == F.floor(as_double(value))), as_double(value).cast("bigint").cast("string")).otherwise(as_text(value)), F.lit("")))
    says = lambda phrases: F.exists(F.coalesce(phrases, F.array().cast("array<string>")), lambda p: has_phrase(text, p))
    aliased = path.isin(*R.dotted(R.ALIASES))
    own = lambda: F.struct(words(as_text(value)).alias("v"), words(text).alias("t"))
    half = let(own(), lambda x: F.size(F.filter(x["v"], lambda w: F.array_contains(x["t"], w))) >= F.greatest(F.lit(1), F.floor(F.size(x["v"]) / 2)))
    every = let(own(), lambda x: F.forall(x["v"], lambda w: F.array_contains(x["t"], w)))
    return (
        F.when(path == "lookup_traffic_law.question", F.lit(True))
        .when(path == "set_reminder.text", half)
        .when(aliased, says(R.lookup(_alias_map(R.ALIASES), spelled)))
        .when(kind(value) == "bool", F.lit(True))
        .when(is_number(value), mentions_number(text, as_double(value)) | says(R.lookup(_alias_map(R.NUMBER_ALIASES), spelled)))
        .when(tool == "lookup_sign", F.contains(alnum(text), alnum(as_text(value))))
        .otherwise(every)
    )


def _raw_texts() -> tuple[Column, Column]:
    user = F.when(F.coalesce(F.col("user_raw"), F.lit("")) != "", F.col("user_raw")).otherwise(F.col("user"))
    return user, F.coalesce(F.col("first_raw"), F.lit(""))


def text_problems() -> Column:
    """Problems of a record's texts, in order."""
    user, first = _raw_texts()
    found = []
    for t in (user, first):
        found.append(F.when((t != "") & normalize(t).rlike(LEAK), F.lit("câu chép lại đề bài")))
        found.append(F.when((t != "") & normalize(t).startswith(ASSISTANT_START), F.lit("câu người dùng lại là câu hỏi của trợ lý")))
    found.append(F.when(mostly_english(F.concat_ws(" ", user, first)), F.lit("câu gần như toàn tiếng Anh")))
    reply = F.lower(F.coalesce(F.col("gold.text"), F.lit("")))
    done = F.lit(False)
    for p in FAKE_DONE:
        done = done | F.contains(reply, F.lit(p))
    chat = F.col("scenario") == "chitchat"
    found.append(F.when(chat & ~reply.rlike(VIETNAMESE), F.lit("chitchat trả lời không phải tiếng Việt")))
    found.append(F.when(chat & done, F.lit("chitchat bịa là đã làm / bịa thông tin")).when(chat & reply.rlike(r"\p{Nd}"), F.lit("chitchat bịa số liệu")))
    return F.array_compact(F.array(*found))


def record_problems() -> Column:
    """All problems of a record, in order; none if it is good."""
    user, first = _raw_texts()
    gold, scenario = F.col("gold"), F.col("scenario")
    schema = F.flatten(F.transform(gold["calls"], lambda c: validate_call(c["name"], c["arguments"])))
    told = classify_text(gold["text"])
    label = F.array_compact(
        F.array(
            F.when((gold["kind"] == "call") & (check_calls(gold["calls"], F.col("state"))["decision"] != "allow"), F.lit("gold gọi tool nhưng luật an toàn chặn")),
            F.when((gold["kind"] != "call") & (F.coalesce(gold["text"], F.lit("")) == ""), F.lit("gold không có text")).when((gold["kind"] != "call") & (told != gold["kind"]), F.concat(F.lit("text gold bị phân loại thành "), told, F.lit(" thay vì "), gold["kind"])),
            F.when(F.length(user) > LONGEST, F.lit("câu quá dài")),
        )
    )
    where = F.when(scenario == "followup", F.concat_ws(" ", user, first)).otherwise(user)
    unsaid = F.flatten(
        F.transform(
            F.coalesce(F.col("seed.calls"), F.array().cast("array<struct<name: string, arguments: map<string, variant>>>")),
            lambda c: F.transform(F.filter(F.map_entries(c["arguments"]), lambda e: ~mentions_value(where, c["name"], e["key"], e["value"])), lambda e: F.concat(F.lit("câu không nhắc "), c["name"], F.lit("."), e["key"], F.lit("="), quoted(e["value"]))),
        )
    )
    omitted = F.col("seed.omitted_value")
    first_call = F.try_element_at(F.col("seed.calls"), F.lit(1))["name"]
    slot = F.when(
        scenario == "missing",
        F.when(is_number(omitted) & user.rlike(r"\p{Nd}"), F.lit("kịch bản thiếu slot số nhưng câu có chữ số")).when((kind(omitted) == "str") & mentions_value(user, first_call, F.col("seed.omitted"), omitted), F.lit("kịch bản thiếu slot nhưng câu vẫn nhắc giá trị")),
    )
    follow = F.when((scenario == "followup") & (F.coalesce(F.size("history"), F.lit(0)) <= 0), F.lit("followup thiếu history"))
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(schema, none), label, F.when(scenario.isin(*WITH_VALUES), F.coalesce(unsaid, none)).otherwise(none), F.array_compact(F.array(slot, follow)), text_problems())


def label_key(gold: Column) -> Column:
    """What near duplicates must share: the kind and the sorted names of the calls."""
    return F.concat(gold["kind"], F.lit(":"), F.array_join(F.array_sort(F.transform(gold["calls"], lambda c: c["name"])), ","))


def dedupe_text() -> Column:
    """What is compared: the user's earlier turns and the user's text."""
    turns = F.transform(F.filter(F.coalesce(F.col("history"), F.array().cast("array<struct<role: string, content: string>>")), lambda m: m["role"] == "user"), lambda m: m["content"])
    return F.trim(F.concat_ws(" ", F.array_join(turns, " "), F.col("user")))


def split_of(group: Column, val: float = 0.05, test: float = 0.10) -> Column:
    """test, val or train by the hash of a group: all rows of a group on one side, whatever else there is."""
    h = seed_hash(group)
    return F.when(h < test, F.lit("test")).when(h < test + val, F.lit("val")).otherwise(F.lit("train"))


def stats(records: DataFrame, by: str | None = None) -> DataFrame:
    """measure, value, n (with `by`, for each of its values): rows, and counts of scenario, kind, style and tool."""
    keys = [by] if by else []
    fact = lambda measure, value: F.struct(F.lit(measure).alias("measure"), value.alias("value"))
    facts = F.array(fact("n", F.lit("")), fact("scenario", F.col("scenario")), fact("kind", F.col("gold.kind")), fact("style", F.col("style")))
    tools = F.transform(F.col("gold.calls"), lambda c: fact("tool", c["name"]))
    return records.select(*keys, F.explode(F.concat(facts, tools)).alias("x")).groupBy(*keys, "x.measure", "x.value").agg(F.count("*").alias("n"))


def top_reasons(problems: DataFrame, k: int = 20) -> DataFrame:
    """reason, n: the most frequent first problems, cut at =; ties in order of the reason."""
    reason = F.split_part(F.element_at("problems", 1), F.lit("="), F.lit(1))
    return problems.where(F.size("problems") > 0).groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def build(raw: DataFrame, seq: Column, threshold: float = 0.85) -> tuple[DataFrame, dict]:
    """The records that stay, with `split`; and the report: raw, invalid, duplicates, invalid_reasons, splits."""
    checked = stored(raw.withColumn("seq", seq).withColumn("problems", record_problems()), "checked")
    good = checked.where(F.size("problems") == 0)
    marked = stored(dedupe(good, F.col("seq"), label_key(F.col("gold")), dedupe_text(), threshold), "marked")
    kept = marked.where(~F.col("duplicate")).withColumn("split", split_of(F.col("group"))).drop("duplicate", "problems")
    n = checked.agg(F.count("*").alias("raw"), F.count_if(F.size("problems") > 0).alias("invalid")).first()
    splits: dict = {s: {"n": 0, "scenario": {}, "kind": {}, "style": {}, "tools": {}} for s in ("train", "val", "test")}
    for r in stats(kept, "split").orderBy(F.desc("n"), "value").collect():  # a row for each label
        if r["measure"] == "n":
            splits[r["split"]]["n"] = r["n"]
        else:
            splits[r["split"]]["tools" if r["measure"] == "tool" else r["measure"]][r["value"]] = r["n"]
    report = {
        "raw": n["raw"],
        "invalid": n["invalid"],
        "duplicates": marked.where("duplicate").count(),
        "invalid_reasons": {r["reason"]: r["n"] for r in top_reasons(checked).collect()},
        "splits": splits,
    }
    return kept, report
