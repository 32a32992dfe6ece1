"""Near copies: SimHash fingerprints in BK-trees, confirmed by the Jaccard similarity of word shingles.

1. ``signatures``: one row per text, in Python over Arrow batches: the hash of its set of
   shingles (``copy``; texts of one set are copies) and the SimHash of that set, of ``BITS`` bits.
2. ``candidates``: a bit differs between two sets of similarity s with probability
   arccos(2 s / (1 + s)) / pi, 0.15 at 0.8, so a radius that has nearly all pairs at 0.8 is too
   wide for blocks that must agree. Each fingerprint goes to a shard in each of many tables, keyed by
   bits drawn for the table; there are so many tables that two sets at the least similarity meet
   nowhere with probability ``MISSED`` only. Each shard is a BK-tree, and what a search of it
   finds within the radius is linked, by a star for each of the shard's groups.
3. ``groups``: the components of these links, in which near copies are looked for.
4. ``links``: one text of each copy goes to its group's task with its shingles as 64-bit
   hashes. Only pairs whose exact similarity is at least ``least`` are linked. Pairs are
   found over the rarest shingles of a group (two sets that are similar enough share one of
   the rarest fifth of each); those that are linked through others already aren't compared.
5. Components over the links, as in ``simhash``.

The number of key bits follows that of the texts, so that shards have about ``SHARD`` members; a
shard with more of them, as of near copies, is searched whole like any other. At this radius a
tree of unlike texts prunes little: what bounds the search is the size of the shards.

Defined results: words are those of ``simhash``; a text of fewer words than a shingle is one
shingle; null and empty texts, and those without words, are copies of each other and near to
nothing else; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import simhash
from fieldloom.llm.shared import cut, join_classes, maybe_in, one_of_each, release_memory

BITS = 192
#: Members of a shard, about, and the share of pairs at the least similarity that meet in no table.
SHARD, MISSED = 256, 1e-4
#: Pairs of a query and a node that a search holds at once.
VISITS = 1 << 16
_P = np.uint64(0x9E3779B97F4A7C15)
_TIMES = np.random.default_rng(42).integers(0, 1 << 63, BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)
#: For bytes of a fingerprint: which shingle breaks their ties.
_TURNS = np.random.default_rng(43).integers(0, 1 << 63, BITS // 8, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """The sorted hashes of a UTF-8 text's shingles, each once."""
    from xxhash import xxh64_intdigest

    parts = [np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found)) for found in (p.lower().split() for p in simhash._stretches(text or b""))]
    w = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    size = min(words, len(w))
    if not size:
        return w
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = h * _P + w[i : i + len(h)]
    return np.unique(_mixed(h))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles, as bytes: a bit is 1 if it is in over half of the shingles' hashes.

    A tie, which a few shingles often have, goes by one shingle, another for each byte: so
    fingerprints of unlike small sets differ in half of their bits as others do."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(found), 255):
        ones += np.unpackbits(_hashes(found[i : i + 255]), axis=1).sum(axis=0, dtype=np.uint8)
    bits = 2 * ones > len(found)
    if len(found) % 2 == 0:
        picks = np.array([_mixed(found * t).argmin() for t in _TURNS]) if len(found) < 64 else np.zeros(BITS // 8, np.int64)
        one = np.unpackbits(_hashes(found[picks])[np.arange(BITS // 8), np.arange(BITS // 8)])
        bits = np.where(2 * ones == len(found), one, bits)
    return np.packbits(bits)


def _hashes(found: np.ndarray) -> np.ndarray:
    """``BITS`` bits for each shingle, as rows of bytes."""
    return _mixed(found[:, None] * _TIMES).view(np.uint8)


def _copy(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return simhash._signed(xxh64_intdigest(found.tobytes())) if len(found) else 0


def signatures(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash``, ``copy`` and ``fp`` (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, fps = [], []
            for x in batch.column(2):
                found = shingles(x.as_py(), words)
                copies.append(_copy(found))
                fps.append(fingerprint(found).tobytes() if len(found) else None)
            columns = [batch.column(0), batch.column(1), pa.array(copies, pa.int64()), pa.array(fps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "copy", "fp"])
        release_memory()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, copy long, fp binary")


def tables(texts: int, least: tuple[int, int] = (4, 5)) -> tuple[np.ndarray, int]:
    """The bits of each table's key, and the radius of the searches."""
    s = least[0] / least[1]
    p = math.acos(2 * s / (1 + s)) / math.pi
    size = min(max(0, math.ceil(math.log2(max(1, texts) / SHARD))), 48)
    meet = (1 - p) ** size
    n = 1 if meet == 1 else math.ceil(math.log(MISSED) / math.log(1 - meet))
    rng = np.random.default_rng(44)
    bits = np.array([rng.choice(BITS, size, replace=False) for _ in range(n)], np.int64).reshape(n, size)
    return bits, math.ceil(BITS * p + 5.5 * math.sqrt(BITS * p * (1 - p)))


_WORDS = [f"w{k}" for k in range(BITS // 64)]


def _keyed(bits: np.ndarray):
    n, size = bits.shape
    first, place = np.arange(n, dtype=np.int64) << 48, np.int64(1) << np.arange(size, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 1000):
                batch = whole.slice(i, 1000)
                fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8)
                own = np.unpackbits(fps, axis=1)
                keys = np.stack([own[:, b].astype(np.int64) @ place for b in bits]) + first[:, None]
                rep = batch.column(0).to_numpy().astype(np.int64)
                columns = [keys.ravel(), np.tile(rep, n), *[np.tile(w, n) for w in np.ascontiguousarray(fps).view(np.int64).T]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "rep", *_WORDS])
        release_memory()

    return run


def grown(fps: list[np.ndarray], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees of all shards at once: the parent of each member and the distance to it.

    ``root``: the place of the shard's first member. Each tree is that which members make who are
    added one after another, and descend by the edge of their distance until it is free."""
    parent, edge = np.full(len(root), -1, np.int64), np.zeros(len(root), np.int64)
    here = np.flatnonzero(root != np.arange(len(root)))
    at = root[here]
    while len(here):
        code = at * (BITS + 1) + _apart(fps, here, at)
        order = np.argsort(code, kind="stable")
        here, at, code = here[order], at[order], code[order]
        new = np.r_[True, code[1:] != code[:-1]]
        child = here[new]
        parent[child], edge[child] = at[new], code[new] % (BITS + 1)
        at = child[np.cumsum(new) - 1][~new]
        here = here[~new]
        order = np.argsort(here)
        here, at = here[order], at[order]
    return parent, edge


def _apart(fps: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(w[a] ^ w[b]) for w in fps).astype(np.int32)


def within(fps: list[np.ndarray], root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members of one shard within the radius: each with those before it, some at a time.

    A search follows only edges within the radius of the distance, to nodes before its query."""
    parent, edge = grown(fps, root)
    child = np.flatnonzero(parent >= 0)
    code = parent[child] * (BITS + 1) + edge[child]
    order = np.argsort(code)
    child, code = child[order], code[order]
    inner = np.zeros(len(root), bool)
    inner[parent[child]] = True
    queries = np.flatnonzero(parent >= 0)
    before = np.cumsum(queries - root[queries])
    start = 0
    while start < len(queries):
        end = max(start + 1, int(np.searchsorted(before, (before[start - 1] if start else 0) + VISITS, "right")))
        q = queries[start:end]
        node, start = root[q], end
        while len(q):
            d = _apart(fps, q, node)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            more = inner[node]
            q, node, d = q[more], node[more], d[more]
            low = np.searchsorted(code, node * (BITS + 1) + np.maximum(d - radius, 0))
            n = np.searchsorted(code, node * (BITS + 1) + np.minimum(d + radius, BITS), "right") - low
            q = np.repeat(q, n)
            node = child[np.arange(len(q)) + np.repeat(low - np.cumsum(n) + n, n)]
            q, node = q[node < q], node[node < q]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels, each the smallest place of its group, after the groups of ``a`` and ``b`` are joined."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * (2 + len(_WORDS))
        ended, batches = False, iter(batches)
        while not ended:
            batch = next(batches, None)
            ended = batch is None
            if not ended:
                rest = [np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(rest)]
            key = rest[0]
            end = len(key)
            if end and not ended:  # the last shard may go on in the next batch
                end = int(np.searchsorted(key, key[-1]))
            if not end:
                continue
            new = np.r_[True, key[1:end] != key[: end - 1]]
            root = np.flatnonzero(new)[np.cumsum(new) - 1]
            rep, fps = rest[1][:end], [w[:end].view(np.uint64) for w in rest[2:]]
            rest = [x[end:] for x in rest]
            label = np.arange(end)
            for a, b in within(fps, root, radius):
                label = joined(label, a, b)
            linked_ = np.flatnonzero(label != np.arange(end))
            a, b = rep[linked_], rep[label[linked_]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])
        release_memory()

    return run


def candidates(copies: DataFrame, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """``a``, ``b`` (b < a): links that join all copies whose fingerprints are near in a shard.

    A copy has a link in each table at most. They become one, to the smallest of them, and links of
    the others to that one, else a large group would have as many links as members times tables."""
    some = copies.where("fp IS NOT NULL").select("copy", "fp")
    classes = some.groupBy("fp").agg(F.min("copy").alias("rep"))
    bits, radius = tables(some.count(), least)
    parts = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = classes.select("rep", "fp").repartition(parts, "rep").mapInArrow(_keyed(bits), ", ".join(f"{c} long" for c in ["key", "rep", *_WORDS]))
    found = keyed.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_shard_links(radius), "a long, b long")
    same = some.join(classes, "fp").where("copy <> rep").select(F.col("copy").alias("a"), F.col("rep").alias("b"))
    stars = found.union(same).groupBy("a").agg(F.collect_set("b").alias("near")).withColumn("b", F.array_min("near"))
    both = stars.select(F.explode(F.array_append("near", F.col("a"))).alias("a"), "b")
    return both.where("a <> b").distinct()


def groups(copies: DataFrame, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """``copy`` and ``group`` of the copies that are linked with another copy."""
    stars = simhash.components(candidates(copies, least))
    return stars.select(F.col("a").alias("copy"), F.col("b").alias("group")).union(stars.select("b", "b").distinct())


def linked(sets: list[np.ndarray], least: tuple[int, int] = (4, 5)) -> Iterator[tuple[int, int]]:
    """Places of sets whose similarity is at least the fraction: enough pairs to join all that are."""
    over, under = least
    n = len(sets)
    values, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, often))] = np.arange(len(values))
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    ranked = [np.sort(rank[place[e - s : e]]) for s, e in zip(size, ends)]
    seen: dict[int, array] = {}
    label = np.arange(n)
    for x in np.argsort(size, kind="stable").tolist():
        s = ranked[x]
        rare = s[: len(s) - -(-over * len(s) // under) + 1].tolist()
        near = [np.frombuffer(seen[t], np.int64) for t in rare if t in seen]
        others = np.concatenate(near) if near else np.zeros(0, np.int64)
        del near  # else the arrays can't grow
        others = np.unique(others[(label[others] != label[x]) & (under * size[others] >= over * len(s))])
        while len(others := others[label[others] != label[x]]):
            y, others = int(others[0]), others[1:]
            both = len(np.intersect1d(s, ranked[y], assume_unique=True))
            if under * both >= over * (len(s) + int(size[y]) - both):
                label[label == label[y]] = label[x]
                yield x, y
        for t in rare:
            seen.setdefault(t, array("q")).append(x)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had = set()
        for batch in batches:
            new = []
            for k, copy in enumerate(batch.column(1).to_pylist()):
                if copy not in had:
                    had.add(copy)
                    new.append(k)
            found = [shingles(batch.column(2)[k].as_py(), words).tobytes() for k in new]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(new, pa.int64())), batch.column(1).take(pa.array(new, pa.int64())), pa.array(found, pa.binary())], names=["group", "copy", "found"])
        release_memory()

    return run


def _group_links(least: tuple[int, int]):
    def near(members: dict[int, np.ndarray]) -> pa.RecordBatch:
        copies = list(members)
        pairs = [sorted((copies[x], copies[y])) for x, y in linked(list(members.values()), least)] if len(copies) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[1] for p in pairs], pa.int64()), pa.array([p[0] for p in pairs], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, {}
        for batch in batches:
            for g, copy, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if g != group:
                    if members:
                        yield near(members)
                    group, members = g, {}
                if copy not in members:
                    members[copy] = np.frombuffer(found.as_py(), np.uint64)
        if members:
            yield near(members)
        release_memory()

    return run


def links(docs: DataFrame, copies: DataFrame, words: int = 5, least: tuple[int, int] = (4, 5), text_col: str = "text") -> DataFrame:
    """``a``, ``b`` (b < a): links that join all copies whose fingerprints and similarity make them near.

    ``copies``: a row for each copy, with its fingerprint and the hash of one of its texts."""
    one = cut(copies.join(groups(copies, least), "copy").select("copy", "group", "_hash"), "groups")
    texts = docs.select(F.xxhash64(text_col).alias("_hash"), F.col(text_col).cast("binary").alias("text"))
    texts = maybe_in(texts, one, "_hash").where("_maybe").join(one, "_hash")
    sets = texts.select("group", "copy", "text").mapInArrow(_sets(words), "group long, copy long, found binary")
    return sets.repartition("group").sortWithinPartitions("group", "copy").mapInArrow(_group_links(least), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, least: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash``, ``copy`` and ``component``, the smallest copy of the row's component."""
    signed = cut(signatures(docs, words, id_col, text_col), "signatures")
    copies = cut(signed.groupBy("copy").agg(F.min("text_hash").alias("_hash"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n")), "copies")
    stars = simhash.components(links(docs, copies, words, least, text_col)).select(F.col("a").alias("copy"), "b")
    classes = cut(copies.join(stars, "copy", "left").select("copy", "n", F.coalesce("b", "copy").alias("component")), "copies")
    return join_classes(signed.drop("fp"), classes, "copy").select("doc_id", "text_hash", "copy", "component")


def keep_one(docs: DataFrame, words: int = 5, least: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id, null ids last.

    Rows are told apart by id and text, so rows of one id and unlike texts all stay. Of rows
    that are the same in both, one stays, the first by its JSON text.
    """
    return one_of_each(docs, near_duplicates(docs, words, least, id_col, text_col), id_col, text_col)
