"""Text functions as Column expressions: folding, n-grams, similarity, mentions, classification, stable hashes.

All are built-in expressions, so filters and projections stay in the JVM. Words are runs of letters and digits; regular
expressions spell classes out, as Java's, RE2's and others' shorthands differ.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import wraps
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the digits, folded.
DIGITS = ("khong", "mot", "hai", "ba", "bon", "nam", "sau", "bay", "tam", "chin")
# Usual English words, for telling mostly English texts.
ENGLISH = (
    "the", "and", "please", "can", "you", "my", "is", "it", "for", "of", "what", "how", "do", "now", "tell", "if", "are", "your",
    "this", "that", "with", "be", "it's", "i'm", "want", "thanks", "to", "me", "i", "a", "on", "in",
)
# Phrases and ends by which a reply is told a refusal or a question.
STRONG_REFUSALS = ("không an toàn", "nguy hiểm", "không được phép", "không cho phép")
WEAK_REFUSALS = ("không thể", "xin lỗi", "từ chối", "không làm được", "chưa làm được", "không hỗ trợ")
QUESTION_WORDS = ("nào", "bao nhiêu", "mấy", "đâu", "gì", "ai", "bao lâu", "không", "chưa", "chứ")
QUESTION_TAILS = ("ạ", "vậy", "nhỉ", "thế", "nhé")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(fn: Callable[..., Column]) -> Callable[..., Column]:
    """A function of columns that computes each of them once, however often its body names it."""

    @wraps(fn)
    def wrapped(*columns: Column, **options) -> Column:
        names = [f"c{i}" for i in range(len(columns))]
        return let(F.struct(*(c.alias(n) for c, n in zip(columns, names, strict=True))), lambda x: fn(*(x[n] for n in names), **options))

    return wrapped


def _folding() -> tuple[str, str]:
    """Lower-case characters of one code unit that lose their marks, and what is left of them."""
    pairs = []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3 or c.lower() != c:
            continue
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(bare) == 1 and bare != c:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folding()


def fold(s: Column) -> Column:
    """Lower case without diacritics; đ becomes d."""
    return F.translate(F.regexp_replace(F.translate(F.lower(s), _FROM, _TO), r"\p{Mn}+", ""), "đ", "d")


def _compositions() -> list[tuple[str, str]]:
    """(character, mark) to composed character, for lower-case Latin letters with Vietnamese marks, in any order of the marks."""
    marks = "̛̣̀́̂̃̆̉"
    steps: dict[str, str] = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if c.lower() == c and len(parts) > 1 and all(m in marks for m in parts[1:]):
            for order in permutations(parts[1:]):
                before = unicodedata.normalize("NFC", parts[0] + "".join(order[:-1]))
                if len(before) == 1:
                    steps[before + order[-1]] = c
    return sorted(steps.items(), key=lambda x: len(unicodedata.normalize("NFD", x[1])))


_STEPS = _compositions()


def compose(s: Column) -> Column:
    """Decomposed lower-case Vietnamese letters composed; other text as it is."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _STEPS))
    return F.when(s.rlike(r"\p{Mn}"), F.aggregate(steps, s, lambda acc, x: F.replace(acc, x["a"], x["b"]))).otherwise(s)


def words_only(s: Column) -> Column:
    """Runs of what is in no word as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))


def normalize(s: Column, keep_diacritics: bool = False) -> Column:
    """Folded (or, with diacritics kept, lower-cased and composed) words, single-spaced."""
    return words_only(compose(F.lower(s)) if keep_diacritics else fold(s))


def alnum(s: Column) -> Column:
    """Folded, with a-z and 0-9 alone left."""
    return F.regexp_replace(fold(s), "[^a-z0-9]", "")


def char_ngrams(s: Column, n: int = 3) -> Column:
    """The distinct character n-grams of the normalised text with a space at each end; at least one."""
    return let(F.concat(F.lit(" "), normalize(s), F.lit(" ")), lambda p: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - (n - 1))), lambda i: F.substring(p, i, F.lit(n)))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays of distinct ones; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def words(s: Column) -> Column:
    """The words of normalised text; none for an empty one."""
    return let(normalize(s), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def _count(a: Column, x: Column) -> Column:
    return F.size(F.filter(a, lambda y: y == x))


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of shared words, as often as both have them; 1 if neither has words, 0 if one has none."""

    def score(x: Column) -> Column:
        p, g = x["p"], x["g"]
        shared = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, w: acc + F.least(_count(p, w), _count(g, w)))
        f1 = F.when(shared == 0, F.lit(0.0)).otherwise(2.0 * shared / (F.size(p) + F.size(g)))
        return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(f1)

    return let(F.struct(words(pred).alias("p"), words(gold).alias("g")), score)


def number_words(n: int) -> list[str]:
    """The folded ways to say a number from 0 to 100; none beyond."""
    if not 0 <= n <= 100:
        return []
    if n == 100:
        return ["mot tram", "tram"]
    tens, ones = n // 10, n % 10
    if not tens:
        return [DIGITS[ones]]
    name = DIGITS[tens]
    if not ones:
        return ["muoi"] if tens == 1 else [f"{name} chuc", f"{name} muoi"]
    last = ["lam", "nham"] if ones == 5 else ["bon", "tu"] if ones == 4 and tens > 1 else [DIGITS[ones]]
    stems = ["muoi"] if tens == 1 else [name, f"{name} muoi"]
    return sorted(f"{stem} {x}" for stem in stems for x in last)


def _readings() -> Column:
    return F.create_map(*[x for n in range(101) for x in (F.lit(n), F.array(*map(F.lit, number_words(n))))])


def says(normalized: Column, phrase: Column) -> Column:
    """Whether a normalised text has a normalised phrase as whole words."""
    return F.contains(F.concat(F.lit(" "), normalized, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def says_number(normalized: Column, whole: Column) -> Column:
    """Whether a normalised text says a whole number (a long): as digits with none beside them, or in words."""
    digits = F.regexp_like(normalized, F.concat(F.lit("(^|[^0-9])"), whole.cast("string"), F.lit("([^0-9]|$)")))
    spoken = F.coalesce(F.try_element_at(_readings(), whole.cast("int")), F.array().cast("array<string>"))
    return digits | F.exists(spoken, lambda w: says(normalized, w))


def mentions_number(text: Column, n: Column) -> Column:
    """Whether a text says a number; a fraction as <whole>.5, <whole>,5 or "<whole> ruoi"."""
    value = n.cast("double")
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("long")
    half = F.regexp_like(fold(text), F.concat(whole.cast("string"), F.lit("[.,]5|"), whole.cast("string"), F.lit(" ruoi")))
    return F.when(value == F.floor(value), let(normalize(text), lambda t: says_number(t, whole))).otherwise(half)


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether the normalised text has the normalised phrase as whole words."""
    return says(normalize(text), normalize(phrase))


def mostly_english(text: Column, usual: Iterable[str] = ENGLISH, least: int = 3, share: float = 0.3) -> Column:
    """At least so many usual English words, and at least that share of the runs of a-z and apostrophes."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), 1)
    known = F.array(*map(F.lit, usual))
    return let(found, lambda w: let(F.size(F.filter(w, lambda x: F.array_contains(known, x))), lambda n: (n >= least) & (n / F.greatest(F.size(w), F.lit(1)) >= share)))


def classify_text(text: Column, strong: Iterable[str] = STRONG_REFUSALS, weak: Iterable[str] = WEAK_REFUSALS, question_words: Iterable[str] = QUESTION_WORDS, question_tails: Iterable[str] = QUESTION_TAILS) -> Column:
    """refuse, ask or reply: a strong refusal, else a question (a sentence ends in ?, or the last in a question word), else a weak refusal, else a reply."""

    def any_of(t: Column, phrases: Iterable[str]) -> Column:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(t, F.lit(p))
        return hit

    end = "(" + "|".join(question_words) + r")\s*(" + "|".join(question_tails) + r")?\s*[.!…]*$"

    def asks(low: Column) -> Column:
        return low.rlike(r"\?(\s|$)") | F.regexp_replace(low, r"(?s)^.*[.!?…]\s+", "").rlike(end)

    question = let(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), asks)
    return let(normalize(text, keep_diacritics=True), lambda t: F.when((t == "") | t.isNull(), F.lit("reply")).when(any_of(t, strong), F.lit("refuse")).when(question, F.lit("ask")).when(any_of(t, weak), F.lit("refuse")).otherwise(F.lit("reply")))


def seed_hash(s: Column) -> Column:
    """A number in [0, 1) from the text's md5: stable under any partitioning."""
    return F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("double") / float(16**8)


def unit(*parts: Column | str | int) -> Column:
    """The seed_hash of parts joined by |: the engine's only source of chance."""
    return seed_hash(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def pick(options: Column, u: Column) -> Column:
    """The element of an array at a number in [0, 1)."""
    return F.try_element_at(options, (F.floor(u * F.size(options)) + 1).cast("int"))


def weighted(weights: dict[str, float], u: Column) -> Column:
    """The key whose share of the weights, in order, holds a number in [0, 1)."""
    total, below, out = sum(weights.values()), 0.0, None
    keys = list(weights)
    for k in keys[:-1]:
        below += weights[k]
        out = F.when(u * total < below, F.lit(k)) if out is None else out.when(u * total < below, F.lit(k))
    return F.lit(keys[-1]) if out is None else out.otherwise(F.lit(keys[-1]))


def add_typo(text: Column, u: Column, protected: Column) -> Column:
    """One slip in one word: of at least four characters, without digits and not protected (folded, without an end sign). The word, place and slip (two characters swapped, one lost, one doubled) come from the key u."""

    def slip(x: Column) -> Column:
        ws, may = x["ws"], x["may"]
        at = pick(may, unit(u, "word"))
        w = F.element_at(ws, at)
        j = (F.floor(unit(u, "place") * (F.length(w) - 2)) + 2).cast("int")  # neither the first nor the last
        one = F.lit(1)
        head, here = F.substring(w, one, j - 1), F.substring(w, j, one)
        after, rest = F.substring(w, j + 1, one), F.substring(w, j + 2, F.length(w))
        kind = pick(F.array(F.lit("swap"), F.lit("drop"), F.lit("dup")), unit(u, "slip"))
        new = F.when(kind == "swap", F.concat(head, after, here, rest)).when(kind == "drop", F.concat(head, after, rest)).otherwise(F.concat(head, here, here, after, rest))
        return F.when(F.size(may) == 0, text).otherwise(F.array_join(F.transform(ws, lambda v, i: F.when(i + 1 == at, new).otherwise(v)), " "))

    ws = F.split(text, " ", -1)
    fits = F.transform(ws, lambda w, i: F.when((F.length(w) >= 4) & ~w.rlike(r"\p{Nd}") & ~F.array_contains(protected, F.regexp_replace(fold(w), r"^[.,!?]+|[.,!?]+$", "")), i + 1))
    return let(F.struct(ws.alias("ws"), F.filter(fits, lambda i: i.isNotNull()).alias("may")), slip)
