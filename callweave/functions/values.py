"""Values of call arguments: VARIANT kinds, numbers and their spelling, and equality.

A call is struct<name string, arguments map<string, variant>>: a map keeps the order of its keys, and a variant the kind of
its value. Casts of variants are lenient (true becomes 1), so every use asks for the kind first. Integers beyond 64 bits
are decimals to Spark, and floats here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import registry as R
from .text import alnum, let, normalize, once, token_f1, words

CALL = "struct<name: string, arguments: map<string, variant>>"
CALLS = f"array<{CALL}>"


def kind(v: Column) -> Column:
    """int, float, bool, str, dict, list or NoneType."""
    return let(
        F.schema_of_variant(v),
        lambda s: F.when(v.isNull() | s.isNull() | (s == "VOID"), F.lit("NoneType"))
        .when(s == "BIGINT", F.lit("int"))
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), F.lit("float"))
        .when(s == "BOOLEAN", F.lit("bool"))
        .when(s == "STRING", F.lit("str"))
        .when(s.startswith("OBJECT"), F.lit("dict"))
        .otherwise(F.lit("list")),
    )


def is_number(v: Column) -> Column:
    return kind(v).isin("int", "float")


def as_double(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def arguments_of(json: Column) -> Column:
    """The object in a JSON text as map<string, variant>, in its order of keys, the last of equal ones; null if it is none."""

    def last(m: Column) -> Column:
        entries = F.map_entries(m)
        kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda f: f["key"] == e["key"]))
        return F.when(F.size(F.array_distinct(F.map_keys(m))) < F.size(m), F.map_from_entries(kept)).otherwise(m)

    return let(F.from_json(json, "map<string,variant>"), last)


#: Powers of ten as the nearest doubles, from 10 ** -LEAST_POWER on; those from 1 on are exact.
LEAST_POWER = 6
_POWERS = [float(f"1e{i}") for i in range(-LEAST_POWER, 23)]


def _power(e: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _POWERS)), (e + LEAST_POWER + 1).cast("int"))


def _rest(a: Column, b: Column, product: Column) -> Column:
    """a * b - product, exactly, where product is a * b rounded: by halves of 26 bits."""

    def halves(x: Column) -> tuple[Column, Column]:
        high = x * 134217729.0 - (x * 134217729.0 - x)
        return high, x - high

    (a1, a2), (b1, b2) = halves(a), halves(b)
    return ((a1 * b1 - product) + a1 * b2 + a2 * b1) + a2 * b2


def _rounded(size: Column, e: Column) -> Column:
    """size / 10 ** (e - 5) to the nearest whole number, a half to the even one; exactly, as C's printf does it."""
    scale = F.when(e <= 5, _power(5 - e)).otherwise(_power(e - 5))

    def of(x: Column) -> Column:
        # up: near is the rounded product and off what it lacks; down: the rounded quotient, and the remainder over the scale
        off = F.when(e <= 5, _rest(size, x["scale"], x["near"])).otherwise(((size - x["near"] * x["scale"]) - _rest(x["near"], x["scale"], x["near"] * x["scale"])) / x["scale"])
        whole = F.floor(x["near"]).cast("long")
        beyond = (x["near"] - whole.cast("double") - 0.5) + off
        return F.when((beyond > 0) | ((beyond == 0) & (whole % 2 == 1)), whole + 1).otherwise(whole)

    return let(scale, lambda s: let(F.struct(s.alias("scale"), F.when(e <= 5, size * s).otherwise(size / s).alias("near")), of))


def _bare(digits: Column) -> Column:
    """A number's digits without zeros at the end of a fraction."""
    return F.when(F.contains(digits, F.lit(".")), F.regexp_replace(digits, r"\.?0*$", "")).otherwise(digits)


@once
def spelled(x: Column) -> Column:
    """A double as %g writes it: six significant digits, no zeros at a fraction's end, and an exponent below 1e-4 and from 1e6 on, as rounded. Beyond 1e-6 and 1e22 the last digit is Java's."""
    size = F.abs(x)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    near = F.floor(F.log10(size)).cast("int")
    own = F.when(size < _power(near), near - 1).when(size >= _power(near + 1), near + 1).otherwise(near)

    def digits(v: Column) -> Column:
        carried = v["m"] >= 1000000
        e, m = F.when(carried, v["e"] + 1).otherwise(v["e"]), F.when(carried, F.lit(100000).cast("long")).otherwise(v["m"])
        return let(F.struct(e.alias("e"), F.lpad(m.cast("string"), 6, "0").alias("d")), written)

    def written(v: Column) -> Column:
        e, d = v["e"], v["d"]
        one = F.lit(1)
        plain = F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)).otherwise(F.concat(F.substring(d, one, e + 1), F.lit("."), F.substring(d, e + 2, F.lit(6))))
        power = F.concat(F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(e).cast("string"), 2, "0"))
        return F.when((e >= -4) & (e < 6), _bare(plain)).otherwise(F.concat(_bare(F.concat(F.substring(d, one, one), F.lit("."), F.substring(d, F.lit(2), F.lit(5)))), power))

    exact = F.concat(sign, let(own, lambda e: let(F.struct(e.alias("e"), _rounded(size, e).alias("m")), digits)))
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), F.lit("nan"))
        .when(size == float("inf"), F.concat(sign, F.lit("inf")))
        .when((x == 0) & x.cast("string").startswith("-"), F.lit("-0"))
        .when((x == F.floor(x)) & (size < 1e6), x.cast("bigint").cast("string"))
        .when((size < 1e21) & (size >= 1e-5), exact)
        .otherwise(F.regexp_replace(F.format_string("%.5e", x), r"\.?0+e", "e"))
    )


@once
def quoted(v: Column) -> Column:
    """A value as Python spells it."""
    text = as_text(v)
    k = kind(v)
    string = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))
    whole_float = F.concat(as_double(v).cast("bigint").cast("string"), F.lit(".0"))
    return (
        F.when(k == "str", string)
        .when(k == "bool", F.when(as_text(v) == "true", F.lit("True")).otherwise(F.lit("False")))
        .when(k == "NoneType", F.lit("None"))
        .when((k == "float") & (as_double(v) == F.floor(as_double(v))), whole_float)
        .when(k.isin("dict", "list"), F.to_json(v))
        .otherwise(text)
    )


@once
def number_of(v: Column) -> Column:
    """A number, or the number in a string that is one; null for everything else, booleans too."""
    string = F.regexp_replace(F.trim(as_text(v)), r"^\+", "")
    plain = F.when(string.rlike(r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), string.try_cast("double"))
    return F.when(is_number(v), as_double(v)).when(kind(v) == "str", plain)


@once
def canonical(name: Column, arguments: Column) -> Column:
    """Arguments without those that equal their default."""

    def default(k: Column, v: Column) -> Column:
        own = F.lit(False)
        for (tool, param), value in R.DEFAULTS.items():
            same = (kind(v) == "str") & (as_text(v) == value) if isinstance(value, str) else is_number(v) & (as_double(v) == float(value))
            own = own | ((name == tool) & (k == param) & same)
        return own

    return F.map_filter(arguments, lambda k, v: ~F.coalesce(default(k, v), F.lit(False)))


def _pairs(pairs: tuple[tuple[str, str], ...], name: Column, key: Column) -> Column:
    return F.concat(name, F.lit("."), key).isin(*[f"{a}.{b}" for a, b in pairs])


@once
def name_equal(gold: Column, pred: Column) -> Column:
    """All words of gold are in pred, or the reverse with pred at least half as long; false without words."""

    def same(x: Column) -> Column:
        g, p = x["g"], x["p"]
        none = (F.size(g) == 0) | (F.size(p) == 0)
        return ~none & ((F.size(F.array_except(g, p)) == 0) | ((F.size(F.array_except(p, g)) == 0) & (F.size(p) * 2 >= F.size(g))))

    return let(F.struct(F.array_distinct(words(gold)).alias("g"), F.array_distinct(words(pred)).alias("p")), same)


@once
def arg_equal(name: Column, key: Column, gold: Column, pred: Column, least_f1: float = 0.5) -> Column:
    """Whether a predicted value is right. A numeric gold takes a numeric string, not the reverse."""
    kg, kp = kind(gold), kind(pred)
    tg, tp = as_text(gold), as_text(pred)
    as_gold = F.when(kg == "bool", F.initcap(tg)).otherwise(F.coalesce(tg, F.lit("None")))
    strings = (normalize(tg) == normalize(tp)) | ((alnum(tg) != "") & (alnum(tg) == alnum(tp)))
    same = (
        F.when(_pairs(R.FREE_TEXT, name, key), (kp == "str") & (token_f1(tp, as_gold) >= least_f1))
        .when(_pairs(R.NAMES, name, key), (kp == "str") & name_equal(as_gold, tp))
        .when((kg == "bool") | (kp == "bool"), (kg == kp) & (tg == tp))
        .when(is_number(gold), F.abs(as_double(gold) - number_of(pred)) < 1e-6)
        .when((kg == "str") & (kp == "str"), strings)
        .otherwise((kg == kp) & (F.coalesce(F.to_json(gold), F.lit("null")) == F.coalesce(F.to_json(pred), F.lit("null"))))
    )
    return F.coalesce(same, F.lit(False))


@once
def call_equal(gold: Column, pred: Column) -> Column:
    """Same name, same arguments but for defaults, and all values right."""

    def same(x: Column) -> Column:
        g, p = x["g"], x["p"]
        keys = (F.size(g) == F.size(p)) & (F.size(F.array_except(F.map_keys(g), F.map_keys(p))) == 0)
        return keys & F.forall(F.map_entries(g), lambda e: arg_equal(gold["name"], e["key"], e["value"], F.try_element_at(p, e["key"])))

    both = F.struct(canonical(gold["name"], gold["arguments"]).alias("g"), canonical(pred["name"], pred["arguments"]).alias("p"))
    return F.coalesce((gold["name"] == pred["name"]) & pred["arguments"].isNotNull() & let(both, same), F.lit(False))


@once
def calls_equal(gold: Column, pred: Column) -> Column:
    """As many calls, and each gold call takes the first equal one that is left."""

    def step(used: Column, g: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(pred), F.lit(1))), lambda i: ~F.array_contains(used, i) & call_equal(g, F.try_element_at(pred, i)))
        return F.concat(used, let(at, lambda x: F.when(F.size(x) > 0, F.slice(x, 1, 1)).otherwise(F.array(F.lit(-1)))))

    met = F.aggregate(gold, F.array().cast("array<int>"), step)
    return (F.size(gold) == F.size(pred)) & ((F.size(gold) == 0) | ~F.array_contains(met, -1))


@once
def actions_match(gold: Column, pred: Column) -> Column:
    """Same kind and, for calls, equal calls; texts are not compared."""
    return (gold["kind"] == pred["kind"]) & ((gold["kind"] != "call") | calls_equal(gold["calls"], pred["calls"]))


@once
def arg_counts(gold: Column, pred: Column) -> Column:
    """struct<tp, fp, fn> of arguments: each gold call meets the first predicted call of its name that is left."""

    def size_of(c: Column) -> Column:
        return F.size(canonical(c["name"], c["arguments"]))

    def step(acc: Column, g: Column) -> Column:
        at = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.size(pred), F.lit(1))), lambda i: ~F.array_contains(acc["used"], i) & (F.try_element_at(pred, i)["name"] == g["name"])))
        met = lambda x: x["at"].isNotNull()

        def found(at: Column) -> Column:
            p = F.try_element_at(pred, F.coalesce(at, F.lit(2147483647)))
            return F.struct(at.alias("at"), canonical(g["name"], g["arguments"]).alias("ga"), F.when(at.isNotNull(), canonical(p["name"], p["arguments"])).alias("pa"))

        def with_hit(x: Column) -> Column:
            hit = F.size(F.filter(F.map_entries(x["ga"]), lambda e: F.map_contains_key(x["pa"], e["key"]) & arg_equal(g["name"], e["key"], e["value"], F.try_element_at(x["pa"], e["key"]))))
            return F.struct(x["at"].alias("at"), F.size(x["ga"]).alias("ga"), F.size(x["pa"]).alias("pa"), F.when(met(x), hit).otherwise(F.lit(0)).alias("hit"))

        def added(x: Column) -> Column:
            return F.struct(
                F.when(met(x), F.concat(acc["used"], F.array(x["at"]))).otherwise(acc["used"]).alias("used"),
                (acc["tp"] + x["hit"]).alias("tp"),
                (acc["fp"] + F.when(met(x), x["pa"] - x["hit"]).otherwise(F.lit(0))).alias("fp"),
                (acc["fn"] + x["ga"] - x["hit"]).alias("fn"),
            )

        return let(let(let(at, found), with_hit), added)

    zero = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn"))

    def rest(acc: Column) -> Column:
        left = F.aggregate(F.transform(pred, lambda p, i: F.when(F.array_contains(acc["used"], i + 1), F.lit(0)).otherwise(size_of(p))), F.lit(0), lambda a, x: a + x)
        return F.struct(acc["tp"].alias("tp"), (acc["fp"] + left).alias("fp"), acc["fn"].alias("fn"))

    return F.aggregate(gold, zero, step, rest)
