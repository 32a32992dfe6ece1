"""Near-duplicate classes by SimHash fingerprints and BK-trees.

1. ``fingerprints``: one 64-bit SimHash per text, in Python over Arrow batches.
2. ``links``: equal fingerprints are one class. Two fingerprints that differ in at
   most ``radius`` bits agree in at least two of ``radius + 2`` blocks of bits, so each
   class goes to one shard for each pair of blocks, keyed by the bits of that pair. A
   shard is a BK-tree (children keyed by the integer Hamming distance to their
   parent); a search follows only edges within the radius of the distance. A shard with
   more than ``shard_rows`` classes is split again by the bits that it doesn't fix, in
   the same way. As all its members agree in the fixed bits, a third level has few
   hundred members at most. A shard gives a star of links for each of its groups, never
   all pairs.
3. ``components``: connected components over the links by alternating large-star and
   small-star rounds, each written to the shared folder. A hub's links may be a third of
   all: hubs are few, so their labels are sent to all tasks and their links stay spread.

Trees aren't sent through the driver, which would collect all fingerprints: the keys
bring every possible partner into the shard's own task.

Defined results: a null or empty text, and one without words, has fingerprint zero,
linked like any other; repeated rows have the same results each; rows with a null id get
a fingerprint, link others as any row does, and have the smallest id of their component
(null if none has an id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import cut, drop_cut, join_classes, one_of_each, release_memory

BITS = 64
#: Links of a vertex that one task takes at least.
HUB = 10_000
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def _stretches(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in parts that end at white space, so that long texts need little memory."""
    at = 0
    while at < len(text):
        if len(text) - at > size and (m := _SPACE.search(text, at + size)):
            yield text[at : m.end()]
            at = m.end()
        else:
            yield text[at:]
            return


def simhash(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Fingerprint of a UTF-8 text: A-Z lower-cased, ASCII white space between words."""
    from xxhash import xxh64_intdigest

    ones, n, carry = np.zeros(BITS, np.int64), 0, []
    for part in _stretches(text or b""):
        found = carry + part.lower().split()
        if len(found) >= words:
            shingles = zip(*(found[i:] for i in range(words)))
            h = np.array([xxh64_intdigest(b" ".join(s), seed) for s in shingles], dtype=">u8")
            n += len(h)
            for i in range(0, len(h), 1 << 16):
                ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            carry = found[len(found) - words + 1 :] if words > 1 else []
        else:
            carry = found
    if not n and carry:
        return xxh64_intdigest(b" ".join(carry), seed)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long; ``hashed``: also ``text_hash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(x.as_py(), words, seed) for x in batch.column(1)]
            fps = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, *batch.columns[2:]], names=["doc_id", "fp", *more])
        release_memory()

    more = ["text_hash"] if hashed else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *[F.xxhash64(text_col).alias(c) for c in more])
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in more)]))


class BKTree:
    """Fingerprints by Hamming distance; a child's key is its distance to its parent."""

    def __init__(self):
        self.fps: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, fp: int) -> int:
        node, new = 0, len(self.fps)
        self.fps.append(fp)
        self.children.append({})
        while new:
            d = (self.fps[node] ^ fp).bit_count()
            child = self.children[node].setdefault(d, new)
            if child == new:
                break
            node = child
        return new

    def within(self, fp: int, radius: int) -> Iterator[int]:
        stack = [0] if self.fps else []
        while stack:
            node = stack.pop()
            d = (self.fps[node] ^ fp).bit_count()
            if d <= radius:
                yield node
            for edge, child in self.children[node].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)


def _star(fps: np.ndarray, reps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links of one shard: each member of a group to the group's smallest."""
    tree, root = BKTree(), list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    order = np.argsort(reps, kind="stable")
    values = reps[order].tolist()
    for k, fp in enumerate(fps[order].view(np.uint64).tolist()):
        mine = k
        for other in tree.within(fp, radius):
            a, b = find(other), find(mine)
            root[max(a, b)] = min(a, b)
        tree.add(fp)
    for k in range(len(values)):
        if (r := find(k)) != k:
            yield values[k], values[r]


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 4
        ended = False
        batches = iter(batches)
        while not ended:
            batch = next(batches, None)
            ended = batch is None
            if not ended:
                new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for i in range(4)]
                rest = [np.concatenate(x) for x in zip(rest, new)]
            table, key, fps, reps = rest
            n = len(fps)
            if not n:
                continue
            starts = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (key[1:] != key[:-1])])
            ends = np.r_[starts[1:], n]
            if not ended:  # the last shard may go on in the next batch
                keep = starts[-1]
                starts, ends = starts[:-1], ends[:-1]
                rest = [x[keep:] for x in rest]
            a: list[int] = []
            b: list[int] = []
            size = ends - starts
            two = starts[size == 2]
            near = np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= radius
            pair = np.sort(np.stack([reps[two][near], reps[two + 1][near]], axis=1), axis=1) if near.any() else np.zeros((0, 2), np.int64)
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
                for x, y in _star(fps[s:e], reps[s:e], radius):
                    a.append(x)
                    b.append(y)
            columns = [pa.array(np.r_[pair[:, 1], np.array(a, np.int64)]), pa.array(np.r_[pair[:, 0], np.array(b, np.int64)])]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return run


def _masks(free: list[int], radius: int) -> list[int]:
    """Masks of two blocks each of the free bits; near fingerprints agree under one."""
    blocks = [b.tolist() for b in np.array_split(np.array(free), radius + 2)]
    return [sum(1 << i for b in pair for i in b) for pair in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(rows: DataFrame, masks: list[list[int]]) -> DataFrame:
    """Each class once for each mask of its table's list: ``table`` is the mask's place."""
    literal = F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in masks])
    mine = F.element_at(literal, (F.col("table") + 1).cast("int"))
    each = rows.select("fp", "rep", "table", F.posexplode(mine).alias("k", "mask"))
    table = F.col("table") * F.lit(len(masks[0])) + F.col("k")
    return each.select(table.cast("long").alias("table"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "rep")


def links(classes: DataFrame, radius: int = 2, shard_rows: int = 1024) -> DataFrame:
    """``a``, ``b`` (b < a): links that join all classes (``fp``, ``rep``) within the radius."""
    masks = [_masks(list(range(BITS)), radius)]
    rows = _keyed(classes.select("fp", "rep", F.lit(0).alias("table")), masks)
    out: DataFrame | None = None
    fixed = masks[0]
    while True:
        sizes = rows.groupBy("table", "key").count().where(F.col("count") > 1)
        large = sizes.where(F.col("count") > shard_rows).select("table", "key")
        free = [[i for i in range(BITS) if not m >> i & 1] for m in fixed]
        more = len(free[0]) >= 2 * (radius + 2) and not large.isEmpty()
        here = rows.join(large, ["table", "key"], "left_anti") if more else rows
        shards = here.repartition("table", "key").sortWithinPartitions("table", "key")
        found = shards.select("table", "key", "fp", "rep").mapInArrow(_shard_links(radius), "a long, b long")
        out = found if out is None else out.union(found)
        if not more:
            break
        finer = [_masks(f, radius) for f in free]
        rows = _keyed(rows.join(large, ["table", "key"], "left_semi").select("fp", "rep", "table"), [[m | base for m in ms] for base, ms in zip(fixed, finer)])
        fixed = [m | base for base, ms in zip(fixed, finer) for m in ms]
    return out.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``a``, ``b``: each linked vertex but the smallest, and the smallest of its component."""
    edges = cut(edges, "links")
    for _ in range(max_rounds):
        many = edges.groupBy("a").count().where("count > 1").select("a")
        chain = edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        if many.union(chain).isEmpty():
            return edges
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rows, n = 2 * edges.count(), F.count(F.lit(1)).alias("n")
        least = both.groupBy("a").agg(F.min("b").alias("m"), n).select("a", F.least("a", "m").alias("m"), "n")
        large = join_classes(both, least, "a", rows, HUB).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), n)
        small = join_classes(large, least, "a", rows, HUB).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        drop_cut(edges)
        edges = after
    raise RuntimeError("the components didn't settle")


def _components(fps: DataFrame, radius: int) -> DataFrame:
    """``fps`` with ``top``, the smallest fingerprint of the component, and ``component_id``, its
    smallest id. Fingerprints are the vertices, so that classes without any id link others too."""
    sizes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash")
    stars = components(links(sizes.select("fp", F.col("fp").alias("rep")), radius))
    members = stars.select(F.col("a").alias("fp"), F.col("b").alias("top")).union(stars.select("b", "b").distinct())
    least = members.join(sizes, "fp").groupBy("top").agg(F.min("rep").alias("least"))
    linked = members.join(least, "top")
    classes = sizes.join(linked, "fp", "left")
    classes = classes.select("fp", "n", F.coalesce("top", "fp").alias("top"), F.when(F.col("top").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    return join_classes(fps, cut(classes, "simhash"), "fp").drop("n")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id of the document's component."""
    fps = cut(fingerprints(docs, words, id_col=id_col, text_col=text_col), "simhash")
    return _components(fps, radius).select("doc_id", "fp", "component_id")


def fp_hex(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, words: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id, null ids last.

    Rows are told apart by id and text, so rows of one id and unlike texts all stay. Of rows
    that are the same in both, one stays, the first by its JSON text.
    """
    fps = cut(fingerprints(docs, words, id_col=id_col, text_col=text_col, hashed=True), "simhash")
    found = _components(fps, radius).select("doc_id", "text_hash", F.col("top").alias("component"))
    return one_of_each(docs, found, id_col, text_col)
