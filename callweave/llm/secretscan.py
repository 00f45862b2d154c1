"""Secret scanning: candidates by shape, false positives removed by a random forest.

Candidates are the words of a text that hold a digit or a usual key's beginning, or follow a sign of assignment: a value
without quotes, brackets and a `name=` before it, of eight bytes at least, in words of any length. Values of over MOST bytes
are cut at the signs of further assignments in them, and each part is a candidate. Addresses, numbers, dates and the like are candidates,
too; telling them apart is the forest's task. Its features: length; transitions between character classes; the share of
letter pairs that are usual in words; dictionary coverage; runs; entropy; the words and signs before and after; the path.

The forest is trained on labelled findings: (text, start, end, path, label). `sample_findings` writes such findings from a
fixed seed, for lack of a table of them: keys, tokens and passwords in assignments, and what is mistaken for them;
`long_findings` does so for values of over MOST bytes, of which encoded data is none. The
dictionary is the words around the training findings; usual pairs are counted in them.

Null and empty texts have no candidates. A null path has no words. Rows of equal id are documents of their own. Very long
texts are scanned whole; a word of any length is. As many votes as VOTES asks for are enough; equal features get equal
votes, so copies of a text get the same findings. Positions are in characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, ship, texts_in, unused, utf8, with_text

#: Shortest value, and the longest that is one candidate even with signs of assignment in it.
LEAST, MOST = 8, 512
AROUND = 48
TREES, DEPTH, CUTS = 40, 8, 24
#: A candidate with at least this share of the trees' votes is a secret.
VOTES = 0.5
MARK = b"[SECRET]"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ANCHOR = np.zeros(256, bool)
_ANCHOR[[*b"0123456789=:"]] = True
_VALUE = re.compile(rb"[A-Za-z0-9+/_=\-.~@$!#%&*^]{8,}")
_PART = re.compile(rb"[^&=]+")
_NAME = re.compile(rb"^[A-Za-z_][A-Za-z0-9_.\-]{0,40}(?:=|:(?!//))")
_INNER = re.compile(rb"[A-Za-z_][A-Za-z0-9_.\-]{1,40}=(?=[^=])")
_TRAIL = b".,;:!?'\")]}>=&*#$%"
_WORDS = re.compile(rb"[a-z]{2,}")
#: Words near a value that name it as secret, and words that name examples or something else.
SECRET_NAMES = (b"token", b"password", b"passwd", b"pwd", b"secret", b"api_key", b"apikey", b"access_key", b"auth", b"bearer", b"credential", b"private")
OTHER_NAMES = (b"commit", b"sha", b"hash", b"uuid", b"md5", b"checksum", b"version", b"phone", b"call", b"order", b"isbn", b"mail", b"http", b"example", b"sample", b"placeholder", b"changeme")
PATH_NAMES = ("test", "example", "doc", "mock", "fixture", "sample")
PREFIXES = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"sk-", b"sk_live_", b"xoxb-", b"xoxp-", b"AIza", b"eyJ", b"glpat-", b"npm_")


def candidates(text: bytes) -> list[tuple[int, int]]:
    """(start, end) in bytes of the values that may be secrets."""
    data = np.frombuffer(text, np.uint8)
    anchors = np.flatnonzero(_ANCHOR[data])
    known = []
    for prefix in PREFIXES:
        at = text.find(prefix)
        while at >= 0:
            known.append(at)
            at = text.find(prefix, at + 1)
    if known:
        anchors = np.union1d(anchors, known)
    if not len(anchors):
        return []
    spaces = np.flatnonzero(_SPACE[data])
    at = np.searchsorted(spaces, anchors)
    bounds = np.concatenate(([-1], spaces, [len(data)]))
    words = np.unique(at)
    starts, ends = bounds[words] + 1, bounds[words + 1]
    found: dict[int, int] = {}
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        spans = [(a, b)]
        if b - a <= 24 and text[b - 1 : b] in (b"=", b":") and words[k] + 2 < len(bounds):  # the value is the next word
            spans.append((b + 1, int(bounds[words[k] + 2])))
        for lo, hi in spans:
            word = text[lo:hi]
            name = _NAME.match(word)
            skip = name.end() if name else 0
            for m in _VALUE.finditer(word, skip):
                own = m.group().rstrip(_TRAIL)
                for part in [m] if len(own) <= MOST else _PART.finditer(word, m.start(), m.end()):
                    start, end = part.span()
                    if (name := _INNER.match(word, start, end)) and end - name.end() >= LEAST:
                        start = name.end()  # a name inside quotes or brackets
                    own = word[start:end].rstrip(_TRAIL)
                    if len(own) >= LEAST:
                        found[lo + start] = lo + start + len(own)
    return sorted(found.items())


def _class(c: int) -> int:
    return 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3


_CLASS = np.array([_class(c) for c in range(256)], np.uint8)


@dataclass
class Lexicon:
    """Words, and how usual each pair of letters is in them (26 x 26, at most 1)."""

    words: frozenset[bytes]
    pairs: np.ndarray

    def covers(self, word: bytes) -> bool:
        """Whether word is one of the words, or two of them in a row."""
        if len(word) > 2 * max(map(len, self.words), default=0):
            return False
        return word in self.words or any(word[:i] in self.words and word[i:] in self.words for i in range(3, len(word) - 2))

    @classmethod
    def of(cls, contexts: list[bytes]) -> Lexicon:
        seen = Counter(w for c in contexts for w in _WORDS.findall(c.lower()))
        pairs = np.zeros((26, 26))
        for w, n in seen.items():
            codes = np.frombuffer(w, np.uint8) - 97
            np.add.at(pairs, (codes[:-1], codes[1:]), n)
        return cls(frozenset(w for w, _ in seen.most_common(2000) if len(w) >= 3), np.minimum(1, 26 * pairs / max(1.0, pairs.sum())))


def features(text: bytes, start: int, end: int, path: str | None, lexicon: Lexicon) -> list[float]:
    value = text[start:end]
    codes = np.frombuffer(value, np.uint8)
    kinds = _CLASS[codes]
    n = len(codes)
    share = np.bincount(kinds, minlength=4) / n
    lower = value.lower()
    letters = np.frombuffer(lower, np.uint8).astype(np.int64) - 97
    alpha = (letters >= 0) & (letters < 26)
    both = alpha[:-1] & alpha[1:]
    usual = lexicon.pairs[letters[:-1][both], letters[1:][both]].mean() if both.any() else 0.0
    covered = sum(len(w) for w in _WORDS.findall(lower) if lexicon.covers(w)) / n
    freq = np.bincount(codes) / n
    freq = freq[freq > 0]
    runs = np.diff(np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1], [True]))))
    before, after = text[max(0, start - AROUND) : start].lower(), text[end : end + AROUND].lower()
    near = before[-24:]
    hexa = sum(c in b"0123456789abcdef" for c in lower) / n
    path = (path or "").lower()
    return [
        n,
        *share.tolist(),
        float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0,
        float(usual),
        covered,
        float(-(freq * np.log2(freq)).sum()),
        float(runs.max()),
        hexa,
        float(any(w in near for w in SECRET_NAMES)),
        float(any(w in before or w in after for w in OTHER_NAMES)),
        float(near.rstrip(b" \"'").endswith(b"=") or near.rstrip(b" \"'").endswith(b":")),
        float(text[max(0, start - 1) : start] in (b'"', b"'") and text[end : end + 1] in (b'"', b"'")),
        float(value.startswith(PREFIXES)),
        float(b"@" in value or b"://" in before[-8:] or b"www." in lower),
        value.count(b".") / n,
        value.count(b"-") / n,
        float(len(_WORDS.findall(before))),
        float(any(w in path for w in PATH_NAMES)),
        float(path.count("/")),
    ]


@dataclass
class Forest:
    """Trees as arrays: a node's feature (-1: leaf), threshold, children (left: at most the threshold) and share of label 1."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def votes(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = np.where(x[inner, f[inner]] <= cut[at], left[at], right[at])
            total += value[node]
        return total / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 1) -> Forest:
    """A random forest by Gini impurity: bootstrapped rows, a root of the features at each node."""
    rng = np.random.default_rng(seed)
    k = max(1, round(np.sqrt(x.shape[1])))
    out = []
    for _ in range(trees):
        nodes: list[list[float]] = []

        def build(rows: np.ndarray, level: int, nodes: list = nodes) -> int:
            me, p = len(nodes), float(y[rows].mean())
            nodes.append([-1, 0.0, 0, 0, p])
            if level == depth or len(rows) < 4 or p in (0.0, 1.0):
                return me
            best = (2 * p * (1 - p) - 1e-9, None, None)
            for f in rng.choice(x.shape[1], k, replace=False):
                own = x[rows, f]
                cuts = np.unique(np.quantile(own, np.linspace(0, 1, CUTS + 2)[1:-1]))
                under = own[:, None] <= cuts
                n_left = under.sum(axis=0)
                ok = (n_left > 0) & (n_left < len(rows))
                if not ok.any():
                    continue
                ones = (under & (y[rows][:, None] > 0)).sum(axis=0)
                n_right = len(rows) - n_left
                with np.errstate(divide="ignore", invalid="ignore"):
                    pl, pr = ones / n_left, (y[rows].sum() - ones) / n_right
                    gini = (n_left * 2 * pl * (1 - pl) + n_right * 2 * pr * (1 - pr)) / len(rows)
                i = int(np.argmin(np.where(ok, gini, np.inf)))
                if gini[i] < best[0]:
                    best = (gini[i], int(f), float(cuts[i]))
            if best[1] is not None:
                under = x[rows, best[1]] <= best[2]
                nodes[me][0], nodes[me][1] = best[1], best[2]
                nodes[me][2] = build(rows[under], level + 1)
                nodes[me][3] = build(rows[~under], level + 1)
            return me

        build(rng.integers(0, len(x), len(x)), 0)
        f, c, a, b, v = (np.array(col) for col in zip(*nodes, strict=True))
        out.append((f.astype(np.int64), c.astype(float), a.astype(np.int64), b.astype(np.int64), v.astype(float)))
    return Forest(out)


Finding = tuple[bytes, int, int, str, int]


@dataclass
class Scanner:
    forest: Forest
    lexicon: Lexicon
    votes: float = VOTES

    def scan(self, texts: list[bytes], paths: list[str | None]) -> list[list[tuple[int, int, float]]]:
        """For each text its candidates: start and end in bytes, and the share of votes."""
        spans = [candidates(t) for t in texts]
        rows = [features(t, a, b, p, self.lexicon) for t, p, own in zip(texts, paths, spans, strict=True) for a, b in own]
        votes = iter(self.forest.votes(np.array(rows)).tolist() if rows else [])
        return [[(a, b, next(votes)) for a, b in own] for own in spans]


def train(findings: list[Finding], votes: float = VOTES) -> Scanner:
    lexicon = Lexicon.of([t[max(0, a - AROUND) : a] + b" " + t[b : b + AROUND] for t, a, b, _, _ in findings])
    x = np.array([features(t, a, b, p, lexicon) for t, a, b, p, _ in findings])
    return Scanner(grow(x, np.array([y for *_, y in findings], float)), lexicon, votes)


def sample_findings(n: int = 3000, seed: int = 1) -> list[Finding]:
    """Labelled findings written from a seed: half secrets, half values that are mistaken for them."""
    rng = np.random.default_rng(seed)

    def chars(alphabet: str, k: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))

    def pick(*options: str) -> str:
        return options[int(rng.integers(len(options)))]

    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, b64 = "0123456789abcdef", up + low + dig
    syllables = "the an er on re ti ent ing tion ver sch lich que ment ado cion par est ou le ra in es or al".split()

    def word() -> str:
        return "".join(pick(*syllables) for _ in range(int(rng.integers(1, 4)))) + pick("", "", "", ".", ",")

    def secret() -> tuple[str, str, str]:
        kind = int(rng.integers(9))
        quote = pick('"', "'", "")
        eq = pick(" = ", "=", ": ", " := ")
        if kind == 0:
            return pick("token", "access_token", "auth_token", "secret") + eq + quote, chars(hexa, int(rng.choice([32, 40, 48, 64]))), quote
        if kind == 1:
            return pick("password=", "passwd=", "pwd=", "PASSWORD=", "password: "), chars(hexa if rng.random() < 0.6 else b64, int(rng.integers(10, 25))), ""
        if kind == 2:
            return pick("", "key ", "aws_access_key_id="), pick("AKIA", "ASIA") + chars(up + "234567", 16) if rng.random() < 0.5 else "AKIA" + chars(up + dig, 16), ""
        if kind == 3:
            return pick("", "token ", "token="), pick("ghp_", "gho_") + chars(b64, 36), ""
        if kind == 4:
            return pick("", "api_key" + eq + quote), pick("sk-", "sk_live_", "npm_", "glpat-") + chars(b64, int(rng.integers(20, 44))), quote
        if kind == 5:
            return pick("Authorization: Bearer ", "bearer "), "eyJ" + chars(b64, 30) + "." + chars(b64, 40) + "." + chars(b64 + "-_", 30), ""
        if kind == 6:
            return "secret_access_key" + eq + quote, chars(b64 + "+/", 40), quote
        if kind == 7:
            return pick("apikey", "api_key", "client_secret") + eq + quote, chars(b64, int(rng.integers(24, 40))), quote
        return pick("", "token="), pick("xoxb-", "xoxp-") + chars(dig, 11) + "-" + chars(b64, 24), ""

    def other() -> tuple[str, str, str]:
        kind = int(rng.integers(16))
        if kind == 0:
            return pick("", "id ", "uuid: "), "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12)), ""
        if kind == 1:
            return pick("commit ", "sha1 ", "at revision ", "checksum: ", "md5 "), chars(hexa, int(rng.choice([32, 40, 64]))), ""
        if kind == 2:
            return pick("call ", "phone: ", "+1 (555) ", ""), f"{chars(dig, 3)}-{chars(dig, 4)}", ""
        if kind == 3:
            return pick("", "at ", "host: "), ".".join(str(int(v)) for v in rng.integers(1, 255, 4)), ""
        if kind == 4:
            return pick("", "mail: ", "write to "), f"{chars(low, 6)}.{chars(dig, 2)}@mail{chars(dig, 1)}.example.com", ""
        if kind == 5:
            return pick("", "card ", "order ", "isbn: ", "number "), chars(dig, int(rng.integers(8, 20))), ""
        if kind == 6:
            return pick("password=", "token=", "api_key: "), pick("changeme123", "your_token_here1", "xxxxxxxxxxxx", "example1234", "placeholder", "********12", "password1", "0000000000000000"), ""
        if kind == 7:
            return pick("see ", "", "url: "), f"https://www.{chars(low, 7)}.com/{chars(low, 5)}/{chars(dig, 4)}", ""
        if kind == 8:
            return pick("version ", "v", "release: "), f"{chars(dig, 2)}.{chars(dig, 2)}.{chars(dig, 3)}-{pick('alpha', 'beta', 'rc')}{chars(dig, 1)}", ""
        if kind == 9:
            return pick("on ", "date: ", ""), f"20{chars(dig, 2)}-0{1 + int(rng.integers(9))}-1{chars(dig, 1)}T0{chars(dig, 1)}:{chars(dig, 2)}", ""
        if kind == 10:
            return pick("", "aws_access_key_id="), "AKIA" + pick("IOSFODNN7EXAMPLE", "EXAMPLEEXAMPLE12", "0000000000000000", "XXXXXXXXXXXXXXXX"), ""
        if kind == 11:
            return pick("file ", "path=", ""), f"{chars(low, 4)}/{word().strip('.,')}_{chars(dig, 2)}.{pick('txt', 'html', 'json')}", ""
        if kind == 12:
            return pick("note: ", "name=", "key: ", ""), word().strip(".,") + word().strip(".,") + word().strip(".,") + chars(dig, int(rng.integers(0, 3))), ""
        if kind == 13:
            return pick("", "price=", "size: "), f"{chars(dig, 5)}.{chars(dig, 3)}", ""
        if kind == 14:
            return pick("hash ", "digest: ", "etag: "), chars(hexa, int(rng.choice([24, 32, 40]))), ""
        return pick("", "ref ", "model "), chars(up, 2) + "-" + chars(dig, 6) + "-" + chars(up, 2), ""

    out: list[Finding] = []
    while len(out) < n:
        label = len(out) % 2
        lead, value, tail = secret() if label else other()
        if len(value) < LEAST:
            continue
        before = " ".join(word() for _ in range(int(rng.integers(0, 9))))
        after = " ".join(word() for _ in range(int(rng.integers(0, 9))))
        head = f"{before} {lead}" if before else lead
        path = pick("src0", "src7", "", "app/config.py", "lib/client.js", "deploy/env") if label or rng.random() < 0.6 else pick("tests/data.py", "docs/example.md", "fixtures/mock.json", "src3")
        start = len(head.encode())
        out.append((f"{head}{value}{tail} {after}".encode(), start, start + len(value), path, label))
    return out


def long_findings(n: int = 300, seed: int = 2) -> list[Finding]:
    """Labelled findings of over MOST bytes: half signed tokens and named keys, half encoded data."""
    rng = np.random.default_rng(seed)
    base = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    out: list[Finding] = []
    while len(out) < n:
        label, size = len(out) % 2, int(rng.integers(MOST + 1, 4 * MOST))
        chars = lambda k, alphabet: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
        if label and rng.random() < 0.5:
            lead, value = ("Authorization: Bearer ", "", "jwt ", 'token":"')[int(rng.integers(4))], f"eyJ{chars(33, base)}.eyJ{chars(size - 381, base)}.{chars(342, base + '-_')}"
        elif label:
            lead, value = ("token=", 'secret":"', "private_key: ", "api_key = ", 'access_token":"')[int(rng.integers(5))], chars(size, base + "+/")
        else:
            lead, value = ("", "src=data:image/png;base64,", "url(data:font/woff2;base64,", 'data":"', "payload ")[int(rng.integers(5))], chars(size * int(rng.integers(1, 5)), base + "+/" if rng.random() < 0.7 else "0123456789abcdef")
        out.append((f"{lead}{value} end".encode(), len(lead), len(lead) + len(value), ("src0", "", "app/config.py", "src7")[int(rng.integers(4))], label))
    return out


@lru_cache(maxsize=1)
def default_scanner() -> Scanner:
    return train(sample_findings() + long_findings())


def scanned(docs: DataFrame, scanner: Scanner | None = None, path: str = "source") -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (start, end in characters, score) for each of docs (doc_id, text, and a path)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(scanner or default_scanner())
    paths = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in batches(it, "t", 4 << 20):
            texts = b.column(1).to_pylist()
            found = own.scan(texts, b.column(2).to_pylist())
            kept = [[{"start": len(t[:a].decode()), "end": len(t[:e].decode()), "score": s} for a, e, s in x if s >= own.votes] for t, x in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([len(x) for x in kept], pa.int64()), pa.array(kept, kind)], ["doc_id", "n_candidates", "n_secrets", "secrets"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t"), paths.alias("p"))
    return rows.mapInArrow(run, "doc_id long, n_candidates long, n_secrets long, secrets array<struct<start: bigint, end: bigint, score: double>>")


def masked(docs: DataFrame, scanner: Scanner | None = None, path: str = "source", mark: bytes = MARK) -> DataFrame:
    """docs with the secrets in text replaced by mark, and n_chars, if it is a column, as the new length; null texts stay null."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(scanner or default_scanner())
    schema, names = docs.schema, docs.columns
    paths = F.col(path).cast("string") if path in names else F.lit(None).cast("string")
    rows, text_at = with_text(docs)
    rows = rows.select(paths.alias(unused(rows.columns, "path as text")), *(F.col(f"`{c}`") for c in rows.columns))
    more = len(rows.columns) - len(names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        at = names.index("text")
        for b in batches(it, text_at + 1, 4 << 20):
            texts = texts_in(b.column(text_at + 1))
            columns = list(b.columns[more:])
            out, n_chars = columns[at].to_pylist(), columns[names.index("n_chars")].to_pylist() if "n_chars" in names else None
            for i, (t, found) in enumerate(zip(texts, own.scan(texts, b.column(0).to_pylist()), strict=True)):
                pieces, last = [], 0
                for a, e, s in found:
                    if s >= own.votes and a >= last:
                        pieces += [t[last:a], mark]
                        last = e
                if last:
                    out[i] = (b"".join(pieces) + t[last:]).decode()
                    if n_chars is not None:
                        n_chars[i] = len(out[i])
            columns[at] = pa.array(out, columns[at].type)
            if n_chars is not None:
                columns[names.index("n_chars")] = pa.array(n_chars, columns[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)
