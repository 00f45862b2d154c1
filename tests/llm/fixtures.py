"""Small tables for the tests of the training-data operators."""

import random

WORDS = "the of and to in that is was for on with as by at from his they this have or one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def documents(n=300, seed=1):
    """(doc_id, text, lang, source, n_chars): prose, exact copies, near copies, shared passages, odd rows."""
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    passage = prose(60)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.3 and rows:
            words = (rng.choice(rows)[1] or "x").split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind < 0.4:
            text = f"{prose(30)} {passage} {prose(rng.randint(0, 30))}"
        else:
            text = prose(rng.randint(1, 200)) + rng.choice(["", ".", "\n", " é ü 日本"])
        rows.append((i, text, rng.choice(["en", "de"]), f"src{i % 3}", len(text)))
    return rows


#: Null and empty texts, spaces alone, one word, a repeated row, a null id, a long text, signs without words.
ODD = [
    (900, None, None, None, None),
    (901, "", "en", "s", 0),
    (902, " \n\t ", "en", "s", 4),
    (903, "word", "en", "s", 4),
    (904, "a b c " * 40, "en", "s", 240),
    (904, "a b c " * 40, "en", "s", 240),
    (905, "a b c " * 40, "de", "s", 240),
    (None, "no id here", "en", None, 10),
    (906, "longtext " * 40_000, "en", "s", 360_000),
    (907, "!!! ??? ...", "en", "s", 11),
    (908, "日本語 テキスト é", "ja", "s", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that operators use themselves.
EXTRA = {
    "t": "string", "score": "double", "slice": "long", "part": "int", "row": "string", "fp": "long", "length": "long", "piece": "int", "number": "long", "place": "long",
    "text as bytes": "binary", "path as text": "string", "bands": "array<long>", "sketch": "binary", "group": "long", "key": "long", "best": "string", "h": "long",
}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd(spark, empty=False):
    from pyspark.sql import functions as F

    base = spark.createDataFrame([] if empty else ODD, SCHEMA)
    return base.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in EXTRA.items()))
