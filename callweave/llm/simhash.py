"""SimHash near-duplicate detection with bit-sliced comparison.

Two fingerprints that differ in at most r of 64 bits agree on at least m - r of any m blocks, so each choice of m - r
blocks is a table keyed by those blocks' bits, and every link meets in a table. m grows with the number of fingerprints,
which keeps tables' groups small; any m finds all links. Groups are compared by `bitslice`, never as joined pairs, and
give a spanning star of their links at most. A group larger than CELL is dealt to cells, of which each pair of rows
shares one. Classes are found by spreading the least member with pointer jumping in Spark tables.

`near_duplicates` takes radius-limited links of documents' fingerprints as they are. `similar` is for a Jaccard similarity
of SHARE of the shingle sets, where fingerprints differ in more bits than block tables reach. Its groups are documents that
share a band of shingle minima. In a group, fingerprints of the distinct shingles are compared by `bitslice` as well, up to
REACH bits; what it finds is decided by the sets' similarity itself. No radius holds all pairs of SHARE, so links that are
beyond it are then found among the sets, exactly, by `jaccard`.

Rows with a null text or without words have fingerprint zero and link like any other; for `similar` they are copies of
each other. Null ids stay, with the class of their fingerprint. Empty input gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitslice
from .common import TEXT_ROWS, batches, drop, mix, ship, stored, utf8
from .fingerprints import shingle_hashes, simhash
from .jaccard import alike, spanning_links

#: Rows of a group that are compared together; a larger group is dealt to cells of two portions of about this size.
CELL = 4096
#: Rows taken from the sorted stream at once, up to the next group's end.
PORTION = 1 << 16
#: (fingerprints up to, blocks): more blocks give longer keys and more tables. All of them find the same links.
BLOCKS = ((1 << 24, 6), (1 << 31, 7), (1 << 62, 8))
#: Jaccard similarity of a link of `similar`.
SHARE = 0.8
#: Bands of shingle minima, minima in each: a pair of similarity 0.8 shares a band but for 1 in 2 * 10^7, (1 - 0.8^4)^32.
BANDS, ROWS = 32, 4
#: Bits that fingerprints in a group of `similar` may differ in: a pair of SHARE differs in 9.7 of 64 on average, 2.9 the deviation.
REACH = 20
#: Shingles of a group that are compared together, as CELL for rows.
SHINGLES = 1 << 21
#: Shingles of whole groups whose fingerprints are compared at once; a larger group is compared alone.
AT_ONCE = 1 << 18
#: Bytes of bitmaps of row numbers that go to the executors; larger ones are joined in Spark.
MARKS = 32 << 20
#: Pairs merged at once.
PAIRS = 1 << 16
TEXTS = 4 << 20


def _bands(h: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Band keys of distinct shingle hashes; none for no shingles."""
    if not len(h):
        return np.zeros(0, np.uint64)
    h = mix(h)
    least = np.array([(h * m).min() for m in multipliers], np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[i::ROWS])
    return key


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, fp (64 bits as a long) of k-word shingles of A-Z lower-cased text."""
    ship(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "t", TEXTS):
            fps = [simhash(shingle_hashes(text.lower().split(), k)) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t")).mapInArrow(run, "doc_id long, fp long")


def shingle_sets(docs: DataFrame, k: int, whole: bool = False) -> DataFrame:
    """doc_id, fp, size (distinct k-word shingles of A-Z lower-cased text) and the keys of their bands; whole: their SimHash and hashes instead of the keys.

    fp are 64 bits of all distinct shingles, whatever their repeats: texts of one fp have the same set.
    """
    ship(docs.sparkSession)
    multipliers = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "t", TEXTS):
            fps, sizes, sims, rest = [], [], [], []
            for text in b.column(1).to_pylist():
                h = np.unique(shingle_hashes(text.lower().split(), k))
                fps.append(xxhash.xxh64_intdigest(h.tobytes()))
                sizes.append(len(h))
                rest.append(h.tobytes() if whole else _bands(h, multipliers).view(np.int64))
                if whole:
                    sims.append(simhash(h))
            if whole:
                last = {"simhash": pa.array(np.array(sims, np.uint64).view(np.int64)), "hashes": pa.array(rest, pa.binary())}
            else:
                last = {"bands": pa.ListArray.from_arrays(np.cumsum([0, *map(len, rest)]).astype(np.int32), np.concatenate(rest))}
            columns = [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), *last.values()]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "size", *last])

    kind = "simhash long, hashes binary" if whole else "bands array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t")).mapInArrow(run, f"doc_id long, fp long, size long, {kind}")


def block_tables(nodes: DataFrame, radius: int, count: int) -> DataFrame:
    """table, key, fp: each fingerprint under the bits of every choice of blocks - radius of the blocks."""
    blocks = radius - 4 + next(m for most, m in BLOCKS if count <= most)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("table", "key"))


def _cells(k: Column) -> Column:
    """The cells of a row of a group in k portions, one for each pair of its own portion and any; cell 0 without k."""
    own = F.pmod(F.xxhash64("fp", F.lit(7)), k)
    return F.when(k.isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda j: F.least(own, j) * k + F.greatest(own, j)))


def _dealt(grouped: DataFrame) -> DataFrame:
    """group and the columns but table and key; groups over CELL rows are dealt to one cell for each pair of their portions."""
    hot = grouped.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    k = F.ceil(F.col("n") / CELL).cast("long")
    rest = [c for c in grouped.columns if c not in ("table", "key")]
    dealt = grouped.join(hot.select("table", "key", k.alias("k")), ["table", "key"], "left").select("table", "key", F.explode(_cells(F.col("k"))).alias("cell"), *rest)
    # one 64-bit number for a group: two groups under one number only add pairs that their distance then decides
    return dealt.select(F.xxhash64("table", "key", "cell").alias("group"), *rest)


def links(grouped: DataFrame, radius: int) -> DataFrame:
    """src, dst: a spanning star of the links found in each portion of groups.

    grouped: table, key, fp, without repeated rows.
    """
    ship(grouped.sparkSession)

    def portions(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in it:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            if sum(len(x[0]) for x in held) >= PORTION:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))  # the last group may go on
                if cut:
                    yield tuple(x[:cut] for x in rows)
                held = [tuple(x[cut:] for x in rows)]
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in portions(it):
            values, at = np.unique(fp.view(np.uint64), return_inverse=True)
            parent = np.arange(len(values))
            for a, b in bitslice.near_pairs(key, fp.view(np.uint64), radius):
                for lo in range(0, len(a), PAIRS):
                    bitslice.merge(parent, at[a[lo : lo + PAIRS]], at[b[lo : lo + PAIRS]])
            linked = np.flatnonzero(parent != np.arange(len(values)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(values[linked].view(np.int64)), pa.array(values[parent[linked]].view(np.int64))], ["src", "dst"])

    return _dealt(grouped).select("group", "fp").repartition("group").sortWithinPartitions("group").mapInArrow(run, "src long, dst long").distinct()


def group_links(keys: np.ndarray, sims: np.ndarray, sets: list[np.ndarray], share: float) -> tuple[list[int], list[int]]:
    """Pairs of rows of one key, each similar by share at least, that join all rows which such pairs join; keys are sorted, sets without repeats or empty ones.

    Fingerprints find for each row the first one before it within REACH bits, to be decided by the sets; the sets' index finds what is left.
    """
    n = len(keys)
    before = np.full(n, n)
    for a, b in bitslice.near_pairs(keys, sims, REACH):
        np.minimum.at(before, b, a)
    src: list[int] = []
    dst: list[int] = []
    for j in np.flatnonzero(before < n).tolist():
        i = int(before[j])
        if alike(sets[i], sets[j], share):
            src.append(i)
            dst.append(j)
    parent = np.arange(n)
    bitslice.merge(parent, np.array(src, np.int64), np.array(dst, np.int64))
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, n).tolist()
    for lo, hi in zip([0, *ends], ends, strict=False):
        a, b = spanning_links(sets[lo:hi], share, parent[lo:hi] - lo)
        src += [lo + i for i in a]
        dst += [lo + i for i in b]
    return src, dst


def similar_links(members: DataFrame, share: float) -> DataFrame:
    """src, dst: links of members (group, fp, simhash, hashes) of one group with a Jaccard similarity of share, enough to join all that such links join."""
    ship(members.sparkSession)

    def groups(it: Iterator[pa.RecordBatch]) -> Iterator[dict[int, tuple[int, np.ndarray]]]:
        last, own = None, {}
        for b in it:
            for group, fp, sim, hashes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != last:
                    if own:
                        yield own
                    last, own = group, {}
                own[fp] = sim, np.frombuffer(hashes, np.uint64)
        if own:
            yield own

    def links_in(held: list[dict[int, tuple[int, np.ndarray]]]) -> tuple[list[int], list[int]]:
        keys = np.repeat(np.arange(len(held)), [len(own) for own in held])
        fps = [fp for own in held for fp in own]
        sims = np.array([sim for own in held for sim, _ in own.values()], np.int64).view(np.uint64)
        a, b = group_links(keys, sims, [hashes for own in held for _, hashes in own.values()], share)
        return [fps[i] for i in a], [fps[i] for i in b]

    def portions(it: Iterator[pa.RecordBatch]) -> Iterator[list[dict[int, tuple[int, np.ndarray]]]]:
        held: list[dict[int, tuple[int, np.ndarray]]] = []
        total = 0
        for own in groups(it):
            n = sum(len(hashes) for _, hashes in own.values())
            if held and total + n > AT_ONCE:
                yield held
                held, total = [], 0
            held.append(own)
            total += n
        if held:
            yield held

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in portions(it):
            src, dst = links_in(held)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return members.select("group", "fp", "simhash", "hashes").repartition("group").sortWithinPartitions("group").mapInArrow(run, "src long, dst long").distinct()


def components(edges: DataFrame, rows: int | None = None) -> tuple[DataFrame, list[str]]:
    """node, root for every node of the undirected edges (src, dst): root is the least node of its class; and tables to drop."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    both, at = stored(both, "edges", rows)
    labels, labels_at = stored(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        hop = both.join(labels.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("m"))
        step = labels.join(hop, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new, new_at = stored(step.join(up, "root").select("node", "old", F.least("root", "top").alias("root")), "labels")
        drop(new.sparkSession, labels_at)
        moved = new.where("root <> old").limit(1).count()
        labels, labels_at = new.select("node", "root"), new_at
        if not moved:
            drop(new.sparkSession, at)
            return labels, [labels_at]


def _classes(fps: DataFrame, find: Callable[[DataFrame, int], DataFrame], rows: int | None = None) -> DataFrame:
    """doc_id, fp, component_id for stored fingerprints; find(nodes, count) gives links, in Arrow batches of so many rows."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    count = fps.select(F.approx_count_distinct("fp")).first()[0]
    roots, tables = components(find(nodes, count), rows)
    linked = nodes.join(roots, F.col("fp") == F.col("node"))
    least = linked.groupBy("root").agg(F.min("least").alias("class_least"))
    of_linked = linked.join(least, "root").select("fp", "class_least")
    # stored, so that Spark can split the rows of a fingerprint that very many documents have
    of_node, _ = stored(nodes.join(of_linked, "fp", "left").select("fp", F.coalesce("class_least", "least").alias("component_id")), "classes")
    for at in tables:
        drop(fps.sparkSession, at)
    return fps.select("doc_id", "fp").join(of_node, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable over links of at most radius bits."""
    fps, _ = stored(fingerprints(docs, k), "fps", TEXT_ROWS)
    out = _classes(fps, lambda nodes, count: links(block_tables(nodes.select("fp"), radius, count), radius))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def numbered(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows whose number is one of numbers (number, from monotonically_increasing_id). Rows are shuffled only if bitmaps of the numbers take more than MARKS."""
    bucket, place = F.bitmap_bucket_number("number"), F.bitmap_bit_position("number")
    marks, _ = stored(numbers.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits")), "marks")
    small = marks.select(F.sum(F.octet_length("bits"))).first()[0] or 0
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    both = rows.withColumn("bucket", bucket).join(F.broadcast(marks) if small <= MARKS else marks, "bucket")
    return both.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def similar(docs: DataFrame, k: int = 5, share: float = SHARE, pick: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, component_id: links join documents whose sets of k-word shingles have a Jaccard similarity of share at least.

    pick(docs, wanted): the rows of docs with a doc_id of wanted (least); a join unless given.
    """
    pick = pick or (lambda docs, wanted: docs.join(wanted, F.col("doc_id").cast("long").eqNullSafe(F.col("least")), "left_semi"))
    fps, _ = stored(shingle_sets(docs, k), "sets", TEXT_ROWS)
    used: list[str] = []  # tables that nothing reads once the links are found

    def find(nodes: DataFrame, count: int) -> DataFrame:
        # texts of one set are one row of a group
        one, at = stored(fps.groupBy("fp").agg(F.first(F.struct("size", "bands")).alias("x"), F.min("doc_id").alias("least")).select("fp", "x.*", "least"), "nodes")
        used.append(at)
        rows = one.select("fp", "size", F.explode("bands").alias("key"))
        own = [F.bit_xor(F.xxhash64("fp", F.lit(seed))).alias(f"of{seed}") for seed in (1, 2)]
        found = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("m"), *own).where("n > 1")
        # bands of the same rows are one group
        found = found.groupBy("n", "m", "of1", "of2").agg(F.min("key").alias("key"))
        k_ = F.greatest(F.ceil(F.col("n") / CELL), F.ceil(F.col("m") / SHINGLES)).cast("long")
        dealt = rows.join(found.select("key", k_.alias("k")), "key").select("key", "fp", F.explode(_cells(F.col("k"))).alias("cell"))
        members, at = stored(dealt.select(F.xxhash64("key", "cell").alias("group"), "fp"), "members")
        used.append(at)
        # sets are made again for the members alone, from one text of each
        wanted = members.select("fp").distinct().join(one, "fp").select("least").distinct()
        sets = shingle_sets(pick(docs.select("doc_id", "text"), wanted), k, whole=True).groupBy("fp").agg(F.first("simhash").alias("simhash"), F.first("hashes").alias("hashes"))
        return similar_links(members.join(sets, "fp"), share)

    out = _classes(fps, find, TEXT_ROWS).select("doc_id", "component_id")
    for at in used:
        drop(docs.sparkSession, at)
    return out


def without_copies(docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each class of `similar`: the one of the least doc_id, null ids last; of rows of one doc_id, any one."""
    rows, _ = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("number")), "rows")

    def pick(docs: DataFrame, wanted: DataFrame) -> DataFrame:
        return numbered(docs.withColumnRenamed("doc_id", "number"), wanted.withColumnRenamed("least", "number")).withColumnRenamed("number", "doc_id")

    # classes are found over row numbers that ascend by doc_id within a node, whatever the ids are
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").cast("long").alias("doc_id"), F.col("number").alias("number"))
    classes = similar(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), k, pick=pick).select(F.col("doc_id").alias("number"), F.col("component_id"))
    best = classes.join(rows.select("number", F.col("row.doc_id").alias("doc_id")), "number").groupBy("component_id").agg(F.min(order).alias("best"))
    return numbered(rows, best.select(F.col("best.number").alias("number"))).select("row.*")
