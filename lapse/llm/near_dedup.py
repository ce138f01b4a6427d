"""Operator 3: near-duplicates by bottom-k sketches.

One hash function ranks a document's shingles; the k smallest are its sketch.
Texts with equal shingle sets form one class. Inverted lists of the values that
classes retain bring together what may be similar; the union of two sketches
estimates their similarity; the exact Jaccard similarity on full sets decides.

What keeps lists short, without losing links: two sketches of sets as similar
as the threshold share at least t values (exactly for sets no larger than a
sketch; else up to a chance of 1e-10, from the binomial tail). So each class
needs to be listed only under its rarest values, all but t - 1 of them: a
passage that thousands of texts share is frequent, and sinks to the end.

What keeps long lists linear: every list first compares its members with one
hub. Only lists that the links then leave in two or more components go on;
short ones compare members of different components, long ones (a large group of
near copies, whose outer members may be linked to each other alone) compare the
members outside the largest component with all, in blocks of bounded size, on
full sets. Members that are already connected are never compared, and no pair is
written but those.

A text of any length is one set of shingles in its task. Null or empty text: no shingles, linked with nothing. A row whose doc_id is null
isn't compared. Repeated rows share a class, and a component. Ties don't arise:
the smallest id names a component. An empty table gives an empty result; only
doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import batches_of, packed, rows_of, texts
from lapse.llm.graph import components
from lapse.session import materialize

#: Values of a sketch.
K = 64
#: Most members of a list whose pairs across components are compared one by one, and members of a block otherwise.
SHORT, BLOCK = 32, 256
#: Most classes whose ids are broadcast to find their texts again; beyond it, the join shuffles.
BROADCAST_IDS = 2_000_000
#: Words whose hashes a worker remembers.
MEMO = 50_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int, hashes: dict) -> np.ndarray:
    """Distinct hashes of the text's shingles, ascending. Words are split at ASCII white space, A to Z in lower case;
    fewer words than a shingle are one."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.int64)
    h = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    n = min(size, len(h))
    out = _mix(h[: len(h) - n + 1] + np.uint64(n))
    for j in range(1, n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return np.unique(out.view(np.int64))


def least_shared(k: int, percent: int, miss: float = 1e-10) -> int:
    """Values that two sketches of k share at least, if the sets are `percent` similar, but for a chance of `miss`."""
    p, tail = percent / 100, 0.0
    for x in range(k + 1):
        tail += comb(k, x) * p**x * (1 - p) ** (k - x)
        if tail > miss:
            return max(1, x)
    return k


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """(doc_id, text_hash, n, h1, h2, sketch): set size, a 128-bit hash of the set, and its k smallest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()

        def row(i: int | None, th: int, text: str) -> tuple:
            own = shingle_set(text, size, hashes)
            whole = xxhash.xxh128_intdigest(own.tobytes())
            h1, h2 = (x - (1 << 63) for x in (whole >> 64, whole & (1 << 64) - 1))
            return i, th, len(own), h1, h2, own[:k].tolist()

        yield from batches_of((row(*x) for x in rows_of(batches, "doc_id", "text_hash", "text")), pa.schema([
            ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("sketch", pa.list_(pa.int64()))]))

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        run, "doc_id long, text_hash long, n int, h1 long, h2 long, sketch array<bigint>")


def full_sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(node, set) of the classes (node, doc_id, h1, h2): the text of the class's smallest id is read again."""
    wanted = classes.select("doc_id").distinct()
    own = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    small = classes.count() <= BROADCAST_IDS
    found = own.join(F.broadcast(wanted) if small else wanted, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()

        def row(text: str) -> tuple:
            own = shingle_set(text, size, hashes)
            whole = xxhash.xxh128_intdigest(own.tobytes())
            return *(x - (1 << 63) for x in (whole >> 64, whole & (1 << 64) - 1)), own.tolist()

        yield from batches_of((row(t) for (t,) in rows_of(batches, "text")), pa.schema([
            ("h1", pa.int64()), ("h2", pa.int64()), ("set", pa.list_(pa.int64()))]), 64)

    again = found.select("text").mapInArrow(run, "h1 long, h2 long, set array<bigint>")
    return again.join(classes.select("node", "h1", "h2"), ["h1", "h2"]).select("node", "set").dropDuplicates(["node"])


def near_in_size(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def inverted_lists(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(v, node, n, doc_id): each class under its rarest retained values."""
    t = least_shared(k, percent)
    values = classes.select("node", "n", "doc_id", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    own = values.join(shared, "v").groupBy("node").agg(
        F.first("n").alias("n"), F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("f", "v"))).alias("vs"))
    # Sets well below k are whole in any sketch that they may be linked with, so their bound is exact.
    least = F.when(100 * F.col("n") <= percent * k, F.ceil(F.col("n") * percent / 100)).otherwise(t).cast("int")
    # Values that no other class retains are the rarest and need no list.
    rare = own.withColumn("most", F.greatest(F.size("vs") - least + 1, F.lit(0)))
    return rare.select("node", "n", "doc_id", F.explode(F.slice("vs", F.lit(1), F.col("most"))).alias("x")).select(
        F.col("x.v").alias("v"), "node", "n", "doc_id")


def estimated(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that the union of their sketches leaves possible; exact where it holds both sets whole."""
    own = classes.select("node", "n", "sketch")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(
        own.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    every = F.size(F.array_intersect("sa", "sb"))
    return both.where(F.when(whole, 100 * every >= percent * (F.col("na") + F.col("nb") - every)).otherwise(
        shared >= least_shared(k, percent))).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are as similar as asked."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member of a list with the list's hub, its class of the smallest id."""
    hubs = lists.groupBy("v").agg(F.min(F.struct("doc_id", "node", "n")).alias("hub"), F.count(F.lit(1)).alias("g")).where("g > 1")
    return lists.join(hubs, "v").where((F.col("node") != F.col("hub.node")) & near_in_size(F.col("n"), F.col("hub.n"), percent)).select(
        F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def pairs_across(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components within lists (v, node, n, label) of bounded length."""
    held = lists.groupBy("v").agg(F.collect_list(F.struct("node", "label", "n")).alias("xs"))
    one = held.select("xs", F.explode("xs").alias("x"))
    each = one.select("x", F.explode("xs").alias("y")).where("x.node < y.node AND x.label <> y.label")
    return each.where(near_in_size(F.col("x.n"), F.col("y.n"), percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def compare_block(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether left[i] and right[j] are as similar as asked: shared values are counted by products of 0/1 matrices,
    some thousands of values at a time."""
    values = np.intersect1d(np.concatenate(left), np.concatenate(right))
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096]

        def matrix(sets: list[np.ndarray], part: np.ndarray = part) -> np.ndarray:
            out = np.zeros((len(sets), len(part)), dtype=np.float32)
            for i, own in enumerate(sets):
                place = np.searchsorted(part, own)
                place[place == len(part)] = 0
                out[i, place[part[place] == own]] = 1
            return out

        shared += matrix(left) @ matrix(right).T
    size = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return 100 * shared >= percent * (size - shared)


def links_in_blocks(members: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links between components within families (family, node, label). The members outside a family's
    largest component meet all its members in blocks; a member gets one link to each component that it touches."""
    by_label = members.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
    main = by_label.groupBy("family").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all")).select(
        "family", F.col("m.label").alias("main"), F.ceil(F.col("all") / block).cast("int").alias("cols"),
        F.ceil((F.col("all") - F.col("m.n")) / block).cast("int").alias("rows")).where("rows > 0")
    placed = members.join(main, "family").join(sets, "node")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    slot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    right = placed.select("family", spread("rows").alias("i"), slot("cols").alias("j"), F.lit(False).alias("outer"), "node", "label", "set")
    left = placed.where("label <> main").select("family", slot("rows").alias("i"), spread("cols").alias("j"), F.lit(True).alias("outer"), "node", "label", "set")

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        a, b = cell[cell["outer"]], cell[~cell["outer"]]
        if a.empty or b.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        similar = compare_block([np.asarray(x) for x in a["set"]], [np.asarray(x) for x in b["set"]], percent)
        labels, nodes = b["label"].to_numpy(), b["node"].to_numpy()
        out = []
        for i, (node, label) in enumerate(zip(a["node"], a["label"], strict=True)):
            at = np.flatnonzero(similar[i] & (labels != label))
            _, firsts = np.unique(labels[at], return_index=True)
            out += [(node, other) for other in nodes[at[firsts]]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return left.unionByName(right).groupBy("family", "i", "j").applyInPandas(compare, "a long, b long")


def component_ids(docs: DataFrame, size: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) of every row of `docs`; text_hash is xxhash64 of the text."""
    own = materialize(sketches(docs, size, k), "op3-sketches")
    classes = materialize(own.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumn(
        "node", F.monotonically_increasing_id()), "op3-classes")
    lists = materialize(inverted_lists(classes, k, percent), "op3-lists")

    pairs = estimated(hub_pairs(lists, percent), classes, k, percent)
    sets = materialize(full_sets(docs, classes.join(lists.select("node").distinct(), "node", "left_semi"), size), "op3-sets")
    links = materialize(verified(pairs, sets, percent), "op3-links")
    found = components(links)

    labelled = lists.select("v", "node", "n").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = labelled.groupBy("v").agg(F.count(F.lit(1)).alias("g"), F.min("node").alias("hub"), F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m")
    rest = materialize(labelled.join(split.select("v", "g", "hub"), "v"), "op3-open-lists")
    across = verified(estimated(pairs_across(rest.where(F.col("g") <= SHORT), percent), classes, k, percent), sets, percent)
    wide = rest.where(F.col("g") > SHORT)
    families = components(wide.select(F.col("hub").alias("a"), F.col("node").alias("b"))).withColumnRenamed("label", "family")
    members = wide.select("node", "label").distinct().join(families, "node")
    more = materialize(across.unionByName(links_in_blocks(members, sets, percent)), "op3-more-links")

    final = components(links.unionByName(more))
    named = classes.select("h1", "h2", "doc_id", "node").join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least, "label").select("h1", "h2", "component_id")
    joined = own.select("doc_id", "text_hash", "n", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"),
                         component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_hash")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each component: its smallest id. Repeated rows are one document and leave one row."""
    found = materialize(component_ids(docs, size, percent), "op3-found")
    rest = without(packed(docs), found.where("NOT kept"))
    twice = found.where("kept").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    if not twice.isEmpty():
        several = twice.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
        rest = rest.join(several, same, "left_anti").unionByName(rest.join(several, same, "left_semi").dropDuplicates(["doc_id", "th"]))
    return rest.select("whole.*")


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Packed `docs` without `rows` (doc_id, text_hash). Few rows are broadcast, more are shuffled."""
    gone = rows.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    small = F.broadcast(gone) if rows.count() <= BROADCAST_IDS else gone
    return docs.join(small, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_anti")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 80 * (na.n + nb.n - x)),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d JOIN (SELECT a, min(c) AS c FROM r GROUP BY 1) m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
