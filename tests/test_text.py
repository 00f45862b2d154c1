import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callweave.functions import text as T

VIETNAMESE = "Bật Điều hoà 22 độ! Đường_số 5, ậ ở ừ ỹ ẵ ỗ"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def folded(s):
    s = unicodedata.normalize("NFD", s.lower())
    return "".join(c for c in s if unicodedata.category(c) != "Mn").replace("đ", "d")


def normal(s):
    return " ".join("".join(c if c.isalnum() else " " for c in folded(s)).split())


def test_folding_agrees_with_unicode(spark):
    texts = [VIETNAMESE, unicodedata.normalize("NFD", VIETNAMESE), "İß é ü ñ", "", "日本 語", "Ðđ"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.fold(F.col("s")).alias("f"), T.normalize(F.col("s")).alias("n")).collect()
    for r in rows:
        assert r.f == folded(r.s)
        assert r.n == normal(r.s)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aAbB éệĐđ_-.,12 \n\tưỨ", max_size=30), min_size=40, max_size=40))
def test_normalize_property(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.normalize(F.col("s")).alias("n"), T.alnum(F.col("s")).alias("a"), F.size(T.char_ngrams(F.col("s"))).alias("g")).collect()
    for r in rows:
        padded = f" {normal(r.s)} "
        assert r.n == normal(r.s)
        assert r.a == re.sub("[^a-z0-9]", "", folded(r.s))
        assert r.g == len({padded[i : i + 3] for i in range(max(1, len(padded) - 2))})


def test_diacritics_are_kept_and_composed(spark):
    for order in ("ậ", "ậ", "ậ"):
        assert one(spark, T.normalize(F.lit(f"Đ{order}!"), keep_diacritics=True)) == "đậ"


def test_numbers_in_words():
    assert T.number_words(5) == ["nam"]
    assert set(T.number_words(15)) == {"muoi lam", "muoi nham"}
    assert set(T.number_words(24)) == {"hai tu", "hai bon", "hai muoi tu", "hai muoi bon"}
    assert set(T.number_words(30)) == {"ba muoi", "ba chuc"}
    assert T.number_words(10) == ["muoi"] and T.number_words(101) == [] and "tram" in T.number_words(100)


@pytest.mark.parametrize(("text", "n", "says"), [("để 22 độ", 22, True), ("hai mươi hai độ", 22, True), ("hai hai", 22, True), ("220", 22, False), ("22,5 độ", 22.5, True), ("22 rưỡi", 22.5, True), ("hai mươi lăm", 25, True), ("số -5", 5, True), ("", 5, False)])
def test_mentioned_numbers(spark, text, n, says):
    assert one(spark, T.mentions_number(F.lit(text), F.lit(n))) is says


def test_similarities(spark):
    assert one(spark, T.token_f1(F.lit("Mở nhạc"), F.lit("mo nhac"))) == 1.0
    assert one(spark, T.token_f1(F.lit("a a b"), F.lit("a b b"))) == pytest.approx(2 / 3)
    assert one(spark, T.token_f1(F.lit(""), F.lit(""))) == 1.0 and one(spark, T.token_f1(F.lit("a"), F.lit(""))) == 0.0
    empty = F.array().cast("array<string>")
    assert one(spark, T.jaccard(empty, empty)) == 1.0
    assert one(spark, T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5


@pytest.mark.parametrize(("text", "kind"), [("Bạn muốn để mức mấy, từ 1 đến 7?", "ask"), ("Bạn muốn đi đâu", "ask"), ("Không an toàn. Bạn dừng xe nhé?", "refuse"), ("Xin lỗi, mình chưa làm được.", "refuse"), ("Xin lỗi, bạn muốn đi đâu?", "ask"), ("", "reply"), ("Chúc bạn một ngày vui.", "reply"), ("Hẹn gặp lại vào ngày mai.", "ask")])
def test_classified_texts(spark, text, kind):
    assert one(spark, T.classify_text(F.lit(text))) == kind


def test_mostly_english(spark):
    assert one(spark, T.mostly_english(F.lit("Can you please open the window"))) is True
    assert one(spark, T.mostly_english(F.lit("bật AC mode cool cho mình nhé, volume thì xuống hẳn luôn"))) is False


def test_slips_leave_digits_and_protected_words(spark):
    text = "Gọi cho Tuấn1 rồi dẫn đường tới Landmark 81"
    rows = spark.range(60).select(T.add_typo(F.lit(text), F.col("id").cast("string"), F.array(F.lit("landmark"))).alias("x")).collect()
    assert any(r.x != text for r in rows)
    for r in rows:
        assert "Tuấn1" in r.x and "Landmark 81" in r.x and len(r.x.split(" ")) == len(text.split(" "))
    assert one(spark, T.add_typo(F.lit("a b c"), F.lit("1"), F.array().cast("array<string>"))) == "a b c"


def test_hashes_and_weights(spark):
    import hashlib

    for s in ("", "abc", "điều"):
        assert one(spark, T.seed_hash(F.lit(s))) == int(hashlib.md5(s.encode()).hexdigest()[:8], 16) / 16**8
    n = {r.x: r["count"] for r in spark.range(4000).select(T.weighted({"a": 0.7, "b": 0.3}, T.unit(1, F.col("id"))).alias("x")).groupBy("x").count().collect()}
    assert 0.65 < n["a"] / 4000 < 0.75
