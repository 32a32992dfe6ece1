"""Each operator against brute force, and on odd tables."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL, same_rows
from pyspark.sql import functions as F

pytest.importorskip("fieldloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from fieldloom.llm import chat, idfiles, jaccard, langid, linededup, media, merkle, mixing, packing, queries, shared, simhash, tokens, toxicity  # noqa: E402

WORD, BYTE = queries.tokenizer("word_bpe_49k.json"), queries.tokenizer("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, _row int, epoch int, gone string, tokens string"

LONG = " ".join(f"word{k % 977} tail" for k in range(60_000))
ROWS = [
    (1, "The cat sat on the mat and it was warm.\nSecond line here.", "en", "src1"),
    (2, "The cat sat on the mat and it was warm.\nSecond line here.", "en", "src1"),
    (2, "The cat sat on the mat and it was warm.\nSecond line here.", "en", "src1"),
    (3, None, "en", "src1"),
    (4, "", "fr", "src2"),
    (5, " \n\t ", None, "src2"),
    (6, "one", "fr", None),
    (7, "deux mots", "fr", "odd source"),
    (8, LONG, "en", "src3"),
    (9, LONG + " end", "en", "src3"),
    (None, "a text without an id, but with words", "en", "src3"),
    (None, None, None, None),
    (10, "Ünïcödé 漢字 😀 text with \x1c odd spaces\r\n\r\n  and 'quotes' we'll see <|endoftext|>", "de", "src4"),
    (11, "!!! 123 ###", "de", "src4"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, None, "x", 1, 2, "g", "t") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


# 1 near duplicates


def _simhash(text, words=3):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def _groups(fps, radius):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = sorted(fps.items())
    for k, (a, x) in enumerate(items):
        for b, y in items[:k]:
            if (x ^ y).bit_count() <= radius:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in fps}


def test_simhash_against_all_pairs(spark, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, SMALL).collect()}
    fps = {i: _simhash(t) for i, t in texts.items()}
    groups = _groups(fps, 2)
    assert got == {i: (f"{fps[i]:016x}", groups[i]) for i in texts}


def test_simhash_of_stretches_is_that_of_the_whole(monkeypatch):
    whole = simhash.simhash(LONG.encode())
    monkeypatch.setattr(simhash, "_stretches", lambda t, size=1000: _real(t, 1000))
    assert simhash.simhash(LONG.encode()) == whole == _simhash(LONG)


_real = simhash._stretches


@pytest.mark.parametrize("shard_rows", [1024, 20, 4])
@pytest.mark.parametrize("radius", [2, 3])
def test_links_of_crowded_shards(spark, shard_rows, radius):
    """Most fingerprints near each other, so that shards are split to the last level."""
    rng = random.Random(radius)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 150:
        x = base
        for _ in range(rng.randrange(9)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = dict(enumerate(sorted(fps)))
    classes = spark.createDataFrame([(simhash._signed(x), i) for i, x in fps.items()], "fp long, rep long")
    stars = {r["a"]: r["b"] for r in simhash.components(simhash.links(classes, radius, shard_rows)).collect()}
    assert {i: stars.get(i, i) for i in fps} == _groups(fps, radius)


def test_bk_tree_finds_all():
    rng = random.Random(5)
    fps = [rng.getrandbits(16) for _ in range(300)]
    tree = simhash.BKTree()
    for x in fps:
        tree.add(x)
    for q in fps[:40]:
        assert sorted(tree.within(q, 3)) == [k for k, x in enumerate(fps) if (x ^ q).bit_count() <= 3]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(101, 100)], "a long, b long")
    assert {r["a"]: r["b"] for r in simhash.components(edges).collect()} == {**{k: 0 for k in range(1, 41)}, 101: 100}


def test_near_duplicates_of_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["fp"], r["component_id"]))
    assert by[2] == by[1] and by[3] == {(0, 3)} and by[4] == {(0, 3)} and by[5] == {(0, 3)}
    assert (0, 3) in by[None]  # a null text's class has ids
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one(odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and simhash.keep_one(empty).count() == 0
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[3] == 1 and ids[4] == 0 and ids[None] == 1
    assert ids[8] == 1


def test_unlike_rows_of_an_id_stay(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = spark.createDataFrame([(1, a), (5, a), (5, b), (1, b + " c"), (7, "something else altogether now")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(rows).collect())) == sorted([(1, a), (5, b), (1, b + " c"), (7, "something else altogether now")])


def test_classes_without_ids_link(spark, monkeypatch):
    """1 and 2 are four bits apart, and two each from a class whose rows have no id."""
    rows = spark.createDataFrame([(1, 0b1100), (2, 0b0011), (None, 0), (None, 0), (3, 0x7F00), (None, -1)], "doc_id long, fp long")
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash._components(rows, 2).collect()}
    assert got == {(1, 0b1100): 1, (2, 0b0011): 1, (None, 0): 1, (3, 0x7F00): 3, (None, -1): None}


def test_common_classes_are_joined_whole(spark):
    rows = spark.createDataFrame([(k, 7 if k < 250 else k) for k in range(600)], "doc_id long, fp long")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("fp <> 300")
    got = shared.join_classes(rows, classes, "fp")
    assert {r["doc_id"]: (r["least"], r["n"]) for r in got.collect()} == {k: (0, 250) if k < 250 else (k, 1) if k != 300 else (None, None) for k in range(600)}


def _shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def _likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _near_texts(n, seed=3, size=100, most=12):
    """Texts of random words, each after the first an edit of an earlier one or a new one."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        words = rng.choice(out).split() if out and rng.random() < 0.7 else [f"w{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(rng.randrange(most)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(5000)}"
        out.append(" ".join(words))
    return out


def _joined(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        p, q = root[a], root[b]
        root = [min(p, q) if x in (p, q) else x for x in root]
    return root


def test_linked_sets_against_all_pairs():
    texts = _near_texts(150)
    sets = [_shingles(t) for t in texts]
    hashed = [jaccard.shingles(t.encode()) for t in texts]
    assert [len(s) for s in sets] == [len(h) for h in hashed]
    near = [(a, b) for a in range(150) for b in range(a) if _likeness(sets[a], sets[b]) >= 0.8]
    found = list(jaccard.linked(hashed))
    assert near and set(map(tuple, map(sorted, found))) <= set(map(tuple, map(sorted, near)))
    assert _joined(150, found) == _joined(150, near)


def _fingerprints(n, seed=5):
    """Bytes of fingerprints: groups of some that are few bits from their first, and others."""
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 2, (n, jaccard.BITS), np.uint8)
    for k in range(n):
        if k % 10 < 4:
            fps[k] = fps[k // 10 * 10] ^ (rng.random(jaccard.BITS) < 0.1)
    return np.packbits(fps, axis=1)


def test_searches_of_trees_against_all_pairs():
    fps = _fingerprints(900)
    words, root = list(np.ascontiguousarray(fps).view(np.uint64).T), np.arange(900) // 300 * 300
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2, dtype=np.int64)
    parent, edge = jaccard.grown(words, root)
    assert all(edge[k] == apart[k, parent[k]] for k in range(900) if parent[k] >= 0) and (parent < 0).sum() == 3
    assert len({(p, e) for p, e in zip(parent.tolist(), edge.tolist()) if p >= 0}) == 897
    for radius in (0, 20, 57, 90):
        found = [p for a, b in jaccard.within(words, root, radius) for p in zip(a.tolist(), b.tolist())]
        want = {(a, b) for a in range(900) for b in range(root[a], a) if apart[a, b] <= radius}
        assert len(found) == len(want) and set(found) == want


def test_candidates_are_near_fingerprints(spark):
    """What the pipeline compares comes from SimHash, and is linked as all near pairs would."""
    fps = _fingerprints(600)
    df = spark.createDataFrame([(k, bytearray(f.tobytes())) for k, f in enumerate(fps)] + [(600, bytearray(fps[7].tobytes())), (601, None)], "copy long, fp binary")
    found = [(r["a"], r["b"]) for r in jaccard.candidates(df).collect()]
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    radius = jaccard.tables(600)[1]
    near = [(a, b) for a in range(600) for b in range(a) if apart[a, b] <= radius] + [(600, 7)]
    assert all(a > b for a, b in found) and _joined(602, found) == _joined(602, near)


def test_fingerprints_of_sets():
    """The rule of bits, on odd sizes; similar sets have near fingerprints, few shingles aren't biased."""
    rng = np.random.default_rng(6)
    for n in (1, 3, 301, 999):
        found = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        bits = np.unpackbits(jaccard._hashes(found), axis=1).sum(axis=0, dtype=int)
        assert (np.unpackbits(jaccard.fingerprint(found)) == (2 * bits > len(found))).all()
    two = np.array([np.unpackbits(jaccard.fingerprint(np.unique(rng.integers(0, 1 << 63, 2, np.uint64)))) for _ in range(300)])
    assert 0.47 < two.mean() < 0.53


def test_links_of_a_large_group_are_few(spark):
    rng = np.random.default_rng(9)
    n = 3000
    fps = np.packbits(rng.integers(0, 2, jaccard.BITS, np.uint8) ^ (rng.random((n, jaccard.BITS)) < 0.07), axis=1)
    df = spark.createDataFrame([(k, bytearray(f.tobytes())) for k, f in enumerate(fps)], "copy long, fp binary")
    found = [(r["a"], r["b"]) for r in jaccard.candidates(df).collect()]
    assert len(found) < 3 * n and len(set(_joined(n, found))) == 1


def test_pipeline_links_by_exact_similarity(spark):
    """An edit in the middle of a text leaves 0.9 of its shingles; texts at 0.6 stay apart."""
    rng = random.Random(8)
    rows, away = [], set()
    for k in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        near, far = list(words), list(words)
        near[50] = "other"  # 91 of 101
        for i in (20, 40, 60, 80):
            far[i] = "other"  # 76 of 116
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
        away.add(3 * k + 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == {i for i, _ in rows} - away


def test_near_copies_of_the_documents(spark):
    """All pairs of distinct texts at 0.8 or more, found over an index of shingles, are linked."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    component = {r["doc_id"]: r["component"] for r in jaccard.near_duplicates(docs).collect()}
    one = {}
    for r in docs.collect():
        one.setdefault(r["text"], r["doc_id"])
    sets = {i: _shingles(t) for t, i in one.items()}
    holders, pairs = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            for k in holders[x]:
                pairs[k, i] += 1
            holders[x].append(i)
    near = [(a, b) for (a, b), n in pairs.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    linked = [component[a] == component[b] for a, b in near]
    assert near and sum(linked) >= 0.9 * len(linked)
    met = {i for pair in near for i in pair}
    groups = Counter(component[i] for i in sets if sets[i])
    assert all(i in met for i in sets if sets[i] and groups[component[i]] > 1)


def test_hubs_are_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HUB", 5)
    edges = [(k, 0) for k in range(1, 60)] + [(100 + k, 59) for k in range(40)] + [(200, 199)]
    got = {r["a"]: r["b"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 60)}, **{100 + k: 0 for k in range(40)}, 200: 199}


def test_jaccard_of_odd_rows(spark, odd, empty):
    found = jaccard.near_duplicates(odd).collect()
    by = defaultdict(set)
    for r in found:
        by[r["doc_id"]].add(r["component"])
    assert len(found) == len(ROWS) and by[1] == by[2] and by[3] == by[4] == by[5] == {0} and 0 in by[None]
    assert by[8] == by[9] and len(by[6] | by[7] | by[10] | by[11] | by[1]) == 5
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.keep_one(empty).count() == 0
    assert jaccard.keep_one(odd).columns == odd.columns


def test_pipeline_decides_by_row(spark):
    a, near, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "axbc")
    near = a + " more"
    rows = [(1, a, "p"), (1, b, "p"), (1, b, "o"), (2, near, "p"), (2, c, "p"), (3, a, "p"), (None, "no id but words", "p"), (None, "no id but words", "p"), (None, b, "p"), (None, None, "p"), (None, "", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_dedup(spark, df, "")
    got = Counter(map(tuple, kept.collect()))
    empty = [r for r in got if not r[1]]
    assert len(empty) == 1 and kept.columns == df.columns
    assert got - Counter(empty) == Counter([(1, a, "p"), (1, b, "o"), (2, c, "p"), (None, "no id but words", "p")])


# 2 language


def test_language_held_out(spark, documents):
    got = {r["doc_id"]: r for r in queries.op2_language(spark, SMALL).collect()}
    assert len(got) == documents.count()
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in documents.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean(right) > 0.95
    for r in got.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1


def test_language_of_odd_rows(odd, empty):
    model = langid.fit(odd, F.lit(True))
    got = langid.predict(odd, model).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r["doc_id"] in (3, 4, 5, 11):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in ("en", "fr", "de")
    assert langid.accepted(odd, model).columns == odd.columns
    none = langid.fit(empty, F.lit(True))
    assert langid.predict(odd, none).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty, model).count() == 0 and langid.accepted(empty, model).count() == 0


def test_language_by_hand(spark, documents, texts):
    """Features one by one, the mean of their rows, softmax with the temperature."""
    model = langid.fit(documents, shared.fold("doc_id", 5) != 0)

    def mixed(h):
        h &= 0xFFFFFFFF
        return (h ^ (h >> 15)) & (len(model.table) - 1)

    def by_hand(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        data = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode())
        total, n = np.zeros(len(model.languages)), 0
        padded = b" " + data + b" "
        for i in range(len(padded) - 2):
            x = padded[i : i + 4]
            three = (x[0] * 0x9E3779B1 + x[1] * 0x85EBCA6B + x[2] * 0xC2B2AE35) & 0xFFFFFFFF
            if x[1] != 32:
                total, n = total + model.table[mixed(three)], n + 1
            if len(x) == 4 and x[1] != 32 and x[2] != 32:
                total, n = total + model.table[mixed(three * 31 + x[3] * 0x27D4EB2F)], n + 1
        e = np.exp((total / max(n, 1) - (total / max(n, 1)).max()) / model.temperature)
        return model.languages[int(np.argmax(e))], float(e.max() / e.sum())

    got = {r["doc_id"]: r for r in langid.predict(documents, model).collect()}
    for i in sorted(texts, key=lambda i: len(texts[i] or ""))[:120]:
        lang, score = by_hand(texts[i])
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-9


def test_language_features_of_slabs(monkeypatch):
    model = langid.Model(["a", "b"], np.random.default_rng(1).normal(size=(1 << 10, 2)))
    whole = model.logits(LONG)
    monkeypatch.setattr(langid, "SLAB", 1000)
    assert np.allclose(model.logits(LONG), whole)


# 3 token files


@pytest.mark.parametrize("planes", ["bytes", "bits"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_file_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 50_000, n).astype("<u4")
    lengths = [n // 2, n - n // 2]
    data = idfiles.encode_file(ids, [5, None], lengths, block=64, planes=planes)
    got, docs, sizes = idfiles.decode_file(data)
    assert (got == ids).all() and docs.tolist() == [5, idfiles.NO_ID] and sizes.tolist() == lengths
    with pytest.raises(ValueError):
        idfiles.decode_file(b"x" + data[1:])


def _plain(file, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file).encode(text or "", add_special_tokens=False).ids


def test_chunked_ids_are_the_librarys():
    rng = random.Random(2)
    bits = [*"  \n\n\t\r.,!'abcXYZéÉß×÷²½٣中́ \x1c |&<>123İſǆ", "'s", "<|endoftext|>", " word", "\n\n  ", "'ll", "naïve", " ", "we'll"]
    for file, spaces in ((WORD, False), (BYTE, True)):
        encoder = tokens.ChunkEncoder(file, spaces)
        for _ in range(3000):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
            assert encoder.ids(text, 9).tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 9]


def test_full_memory_of_chunks(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 3)
    encoder = tokens.ChunkEncoder(BYTE, True)
    assert encoder.ids(LONG[:500]).tolist() == _plain(BYTE, LONG[:500]) and len(encoder) <= 3


def test_token_files(spark, odd, empty, texts, tmp_path):
    at = 0
    got = {r["doc_id"]: r for r in queries.op3_token_files(spark, SMALL).collect()}
    for i in sorted(texts):
        ids = np.array([*_plain(WORD, texts[i]), 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for name, df, rows in (("odd", odd, ROWS), ("empty", empty, [])):
        idfiles.write(df, str(tmp_path / name), WORD, 2, file_ids=100)
        back = sorted(idfiles.read(spark, str(tmp_path / name)).collect(), key=lambda r: r["start"])
        assert Counter(r["doc_id"] for r in back) == Counter(r[0] for r in rows)
        assert [r["doc_id"] or -1 for r in back] == sorted(r["doc_id"] or -1 for r in back)
        assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(back, back[1:]))


# 4 mixing


def test_mixing_same_as_sql(spark, duck):
    same_rows(queries.op4_mixing(spark, SMALL).toPandas(), duck.sql(mixing.SQL).df())


def _share(total, kids):
    """Largest-first water filling by brute force, in fractions."""
    got = dict.fromkeys(kids, 0.0)
    open_ = {k for k, (cap, w) in kids.items() if cap and w}
    left = total
    while open_ and left > 1e-9:
        unit = left / sum(kids[k][1] for k in open_)
        full = {k for k in open_ if got[k] + unit * kids[k][1] >= kids[k][0]}
        if not full:
            for k in open_:
                got[k] += unit * kids[k][1]
            break
        step = min((kids[k][0] - got[k]) / kids[k][1] for k in full)
        for k in open_:
            got[k] += step * kids[k][1]
        left = total - sum(got.values())
        open_ -= {k for k in open_ if kids[k][0] - got[k] < 1e-9}
    return got


@pytest.mark.parametrize("seed", range(4))
def test_shortages_go_to_siblings_first(spark, seed):
    rng = random.Random(seed)
    leaves = [(f"=d{d}", f"=l{x}", rng.randrange(1, 400)) for d in range(3) for x in range(rng.randrange(1, 5))]
    weights = {"d": {f"d{d}": rng.randrange(1, 6) for d in range(3)}, "l": {f"l{x}": rng.randrange(0, 5) for x in range(4)}}
    df = spark.createDataFrame(leaves, "d string, l string, tokens long")
    got = {(r["d"], r["l"]): r["budget"] for r in mixing.budgets(df, ["d", "l"], weights, (7, 10), 1).collect()}
    caps = {(d, x): (t if weights["l"].get(x[1:], 1) else 0) for d, x, t in leaves}
    total = min(sum(t for *_, t in leaves) * 7 // 10, sum(caps.values()))
    top = _share(total, {d: (sum(c for (e, _), c in caps.items() if e == d), weights["d"][d[1:]]) for d in {x[0] for x in leaves}})
    assert sum(got.values()) == total
    for d, want in top.items():
        inner = _share(want, {x: (c, weights["l"].get(x[1:], 1)) for (e, x), c in caps.items() if e == d})
        for x, b in inner.items():
            assert abs(got[d, x] - b) <= 6  # whole tokens at two levels


def test_mixing_odd_rows(odd, empty):
    args = dict(levels=[("lang", F.col("lang")), ("source", F.col("source"))], weights={"lang": {"en": 2}}, share=(3, 1), max_epochs=2)
    mixed = mixing.mix(odd, **args)
    counts = Counter(r["_row"]["doc_id"] for r in mixed.collect())
    assert counts[8] == 2 and counts[2] == 4 and max(r["epoch"] for r in mixed.collect()) == 2
    assert mixing.mix(empty, **args).count() == 0


# 5 lines


def test_lines_same_as_sql(spark, duck):
    same_rows(queries.op5_line_dedup(spark, SMALL).toPandas(), duck.sql(linededup.SQL).df())


def test_boilerplate_of_a_host(spark):
    rows = [(k, f"Accept cookies\n\ntext number {k}\nAccept cookies", "a") for k in range(8)] + [(20 + k, f"Accept cookies\nother {k}", "b") for k in range(3)]
    rows += [(40 + k, "Accept cookies", "a") for k in range(2)] + [(50, None, "a"), (51, "", "a"), (52, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("gone", F.lit(1))
    got = {r["doc_id"]: r["text"] for r in linededup.without_boilerplate(df, 0.5, 5).collect()}
    assert got[3] == "\ntext number 3"
    assert got[21] == "Accept cookies\nother 1"  # too few pages
    assert got[40] == ""  # nothing else on the page
    assert got[50] is None and got[51] == "" and got[52] == "x"


def test_copies_of_a_page_count_once(spark):
    rows = [(k, "the same page\nas ever", "a") for k in range(50)] + [(100 + k, f"page {k}", "a") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert linededup.without_boilerplate(df, 0.5, 2).where("text = 'the same page\nas ever'").count() == 50


def test_pipeline_empties_pages_of_boilerplate(spark):
    rows = [(k, f"Accept cookies\n\nAll rights reserved\ntext {k}", "a") for k in range(8)] + [(20, "Accept cookies\n\nAll rights reserved", "a"), (21, " \n", "a"), (22, None, "a"), (23, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert got[3] == "\ntext 3" and got[20] == "" and got[21] == " \n" and got[22] is None and got[23] == ""


def test_pipeline_drops_lines_of_small_hosts(spark):
    rows = [(k, (f"Accept cookies\ntext {k}" if k < 2 else f"text {k}"), "a") for k in range(20)]
    rows += [(100 + k, (f"Accept cookies\nother {k}" if k < 2 else f"other {k}"), "b") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert got[0] == "text 0" and got[1] == "text 1"  # a tenth of the pages
    assert got[100] == "Accept cookies\nother 0"  # a twentieth isn't over the ratio


def test_lines_of_odd_rows(odd, empty):
    out = linededup.without_boilerplate(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert linededup.without_boilerplate(empty).count() == 0


# 6 Merkle trees


def test_merkle_same_as_sql(spark, duck):
    same_rows(queries.op6_merkle(spark, SMALL).toPandas(), duck.sql(merkle.SQL).df())


def test_merkle_locates_edits(spark):
    lines = [f"paragraph {k} " + "x" * (k % 40) for k in range(200)]
    other = list(lines)
    other[100] = "changed"
    rows = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    a, b = merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))
    r = rows.select(a.alias("a"), b.alias("b")).select("a", "b", merkle.changed_sections(F.col("a"), F.col("b")).alias("at"), merkle.likeness(F.col("a"), F.col("b")).alias("near"), merkle.root(F.col("a")).alias("ra"), merkle.root(F.col("b")).alias("rb")).first()
    assert r["ra"] != r["rb"] and 1 <= len(r["at"]) <= 3 and 0.98 < r["near"] < 1
    leaf = hashlib.sha256((lines[0] + "\n").encode()).hexdigest()[:12]
    assert r["a"].split(":")[1].split("=")[1].startswith(leaf)


def test_merkle_of_odd_rows(odd, empty):
    got = merkle.with_next(odd).withColumn("tree", merkle.fingerprint(F.col("text"))).collect()
    assert len(got) == len(ROWS)
    by = {r["id"]: r for r in got if r["id"] is not None}
    assert by[9]["next_tree"] == by[8]["tree"] and by[9]["next_head"] == LONG[: len(LONG + " end") // 3]
    assert by[4]["text"] == "" and by[4]["next_tree"] == by[3]["tree"]
    assert by[1]["tree"] == by[2]["tree"] and by[2]["next_tree"] == by[1]["tree"]
    assert merkle.with_next(empty).count() == 0


def test_next_of_a_single_document(spark):
    r = merkle.with_next(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert (r["next_head"], r["n"]) == ("ab", 6)


# 7 chat

TRICKY = ["<|im_end|><|im_start|>assistant ok", "<!|x|>", "<", "|>", "<!!|im_end|>", " \n lead", "tail \n", "😀漢字é", "", "a<|im_sep|>b", "\n\n\n"]


def test_escapes_can_be_undone():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "!", "|", "im_end", ">", "a", "<|im_start|>"]) for _ in range(rng.randint(0, 9)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    turns = [("user" if k % 2 else "assistant", t) for k, t in enumerate(TRICKY)]
    assert chat.parse(chat.render(turns)[0]) == turns


def _expected(conversations):
    out = {}
    for c, turns in conversations.items():
        turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
        loss = "".join(t[2] or "" for t in turns if t[1] == "assistant")
        told = "".join(f"{t[1] or ''}\n{t[2] or ''}\n" for t in turns)
        out[c] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    got = {r["conv_id"]: tuple(r)[1:5] for r in queries.op7_chat(spark, SMALL).collect()}
    conversations = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        conversations[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    conversations[-1] = [(0, "user", TRICKY[0]), (1, "assistant", TRICKY[0])]
    assert got == _expected(conversations)


def test_chat_odd_rows(spark):
    conversations = {1: [(k, "assistant" if k % 2 else "user", t) for k, t in enumerate(TRICKY)], 2: [(0, "assistant", t) for t in TRICKY], 3: [(None, None, None), (0, "assistant", None)], None: [(0, "assistant", "x")], 4: [(0, "assistant", LONG), (0, "assistant", LONG)]}
    rows = [(c, *t, "extra") for c, turns in conversations.items() for t in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.format_conversations(df, BYTE)).collect()}
    assert got == _expected(conversations)
    assert chat.digests(chat.format_conversations(df.limit(0), BYTE)).count() == 0


def test_rows_without_a_conversation_stand_alone(spark):
    df = spark.createDataFrame([(None, k, "assistant", f"said {k}") for k in range(3)] + [(1, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    got = sorted((str(r["conv_id"]), r["n_turns"], r["loss_chars"]) for r in chat.digests(chat.format_conversations(df, BYTE)).collect())
    assert got == [("1", 1, 1), *[("None", 1, 6)] * 3]


def test_no_token_reaches_over_a_span(spark):
    df = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(TRICKY)], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(df, BYTE).first()
    _, spans = chat.render([("assistant" if k % 2 else "user", t) for k, t in enumerate(TRICKY)])
    for s, e, chosen in zip(r["starts"], r["ends"], r["mask"]):
        inside = [a <= s and e <= b for a, b in spans]
        assert any(inside) == chosen
    assert len(r["ids"]) == len(r["mask"])


# 8 toxicity


def test_toxicity_separates(spark):
    rng = random.Random(3)
    plain = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(900):
        bad = k % 9 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        if bad:
            for _ in range(max(2, len(words) // 12)):
                words[rng.randrange(len(words))] = rng.choice(["vilething", "nastyword", "slurring"])
        rows.append((k, " ".join(words)))
        if k % 2 == 0:
            labels.append((k, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, shared.fold("doc_id", 4) != 2)
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([got[k] >= 0.3 for k in held if k % 9 == 0]) > 0.9
    assert np.mean([got[k] >= 0.3 for k in held if k % 9]) < 0.05


@pytest.mark.parametrize("shift", [0.0, -3.0])
def test_risk_is_the_plain_formula(shift):
    rng = np.random.default_rng(4)
    zp, zu, prior = rng.normal(1, 2, 9), rng.normal(shift, 2, 14), 0.4

    def loss(z):
        return float(np.mean([np.log(1 + np.exp(-x)) for x in z]))

    def rest(zp, zu):
        return loss(-zu) - prior * loss(-zp)

    assert abs(toxicity.risk(zp, zu, prior) - (prior * loss(zp) + max(0.0, rest(zp, zu)))) < 1e-12
    ascends = rest(zp, zu) < 0
    assert ascends == (shift < 0)
    gp, gu = toxicity.pull(zp, zu, prior)
    target = (lambda p, u: -rest(p, u)) if ascends else (lambda p, u: prior * loss(p) + rest(p, u))
    for k, g in [*((k, gp[k]) for k in range(9)), *((9 + k, gu[k]) for k in range(14))]:
        z = np.concatenate([zp, zu])
        hi, lo = z.copy(), z.copy()
        hi[k] += 1e-6
        lo[k] -= 1e-6
        assert abs((target(hi[:9], hi[9:]) - target(lo[:9], lo[9:])) / 2e-6 - g) < 1e-6


def test_toxicity_without_separating_words(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(20)) for _ in range(140)]
    model = toxicity.train(texts[:40], texts[40:], 0.3)
    scores = {round(model.score(t), 12) for t in texts}
    assert len(scores) == 1 and 0 < scores.pop() < 1


def test_toxicity_scores_by_hand(spark, documents, texts):
    model = toxicity.fit(documents, spark.read.parquet(f"{SMALL}/labels.parquet"), shared.fold("doc_id", 4) != 2)
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(documents, model).collect()}
    for i in sorted(texts)[:40]:
        words = [w.lower() for w in toxicity._WORD.findall(texts[i] or "")]
        total = 0.0
        for w in words:
            named = {"w" + w} | {"p" + w[:n] for n in (4, 5, 6) if len(w) > n}
            total += sum(float(model.weights[b]) for b in {zlib.crc32(x.encode()) % len(model.weights) for x in named})
        z = model.bias + (toxicity.SCALE * total / len(words) if words else 0.0)
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(z, -6, 6)))) < 1e-5


def test_toxicity_query(spark, documents):
    got = queries.op8_toxicity(spark, SMALL).collect()
    assert len(got) == documents.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (8, 0), (9, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, F.lit(True))
    got = toxicity.scores(odd, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scores(empty, model).count() == 0
    none = toxicity.fit(odd, labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.scores(odd, none).collect()} == {0.0}


# 9 media


def test_media_query(spark, texts):
    got = {r["doc_id"]: r for r in queries.op9_media(spark, SMALL).collect()}
    for i, t in texts.items():
        data = t.encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def _plain_hash(image):
    """Each cell of a grid by overlap areas, then the cosine sums term by term."""
    n, low = media.GRID, media.LOW
    rows, columns = image.shape

    def share(size, k, cell):
        return max(0.0, min((k + 1) * size / n, cell + 1) - max(k * size / n, cell)) * n / size

    a = np.array([[share(rows, k, r) for r in range(rows)] for k in range(n)])
    b = np.array([[share(columns, k, c) for c in range(columns)] for k in range(n)])
    grid = a @ image.astype(float) @ b.T
    found = [sum(grid[y, x] * np.cos(np.pi / n * (y + 0.5) * u) * np.cos(np.pi / n * (x + 0.5) * v) for y in range(n) for x in range(n)) for u in range(low) for v in range(low)]
    found = np.round(found, 6)
    return found, np.median(found[1:])


def test_features_and_stored_bytes_by_hand(spark, texts):
    import sys

    got = {r["doc_id"]: r for r in queries.op9_media(spark, SMALL).collect()}
    for i in sorted(texts, key=lambda i: len(texts[i]))[:25]:
        payload = texts[i].encode()
        payload += b"\xff" * (-len(payload) % 576 if payload else 576)
        image = np.frombuffer(payload, np.uint8).reshape(-1, 32)
        found, middle = _plain_hash(image)
        bits = bin(int(got[i]["feature"], 16) | 1 << 64)[3:]
        clear = np.abs(found - middle) > 1e-4
        assert clear.sum() > 50 and all((x > middle) == (bit == "1") for x, bit, sure in zip(found, bits, clear) if sure)
        stored = media.encode(payload, 32)
        assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        # the stored form as a PNG reader sees it: signature, length, size, bit depth 8, grey
        assert stored[:8] == b"\x89PNG\r\n\x1a\n" and stored[12:16] == b"IHDR" and stored[16:29] == (32).to_bytes(4, "big") + len(image).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    assert sys.byteorder == "little"


@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [0, 1, 1, 2, 2, 3, 4, 4, 1, 0]])
def test_all_filters_are_undone(kinds):
    rng = np.random.default_rng(7)
    image = rng.integers(0, 256, (20, 16)).astype(np.uint8)
    rows = np.empty((20, 17), np.uint8)
    for r in range(20):
        kind = kinds[r % len(kinds)]
        rows[r, 0] = kind
        for c in range(16):
            left, up = (int(image[r, c - 1]) if c else 0), (int(image[r - 1, c]) if r else 0)
            corner = int(image[r - 1, c - 1]) if r and c else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            rows[r, c + 1] = (int(image[r, c]) - [0, left, up, (left + up) // 2, paeth][kind]) % 256
    assert (media._unfilter(rows) == image).all()


def test_damage_is_found():
    data = media.encode(media.pad(b"some bytes", 576), 32)
    assert media.decode(data).tobytes() == media.pad(b"some bytes", 576)
    for at in (3, 20, len(data) // 2, len(data) - 6):
        broken = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
        with pytest.raises((ValueError, zlib.error)):
            media.decode(broken)


def test_low_frequencies_survive_small_changes():
    x = np.repeat(np.repeat(np.random.default_rng(1).integers(0, 256, (10, 8)), 4, 0), 4, 1).astype(np.uint8)
    y = x.copy()
    y[7, 9] ^= 3
    a, b = (int(media.frequency_hash(z), 16) for z in (x, y))
    assert (a ^ b).bit_count() <= 6


def test_media_of_odd_rows(odd, empty):
    got = media.from_media(media.to_media(odd, "doc_id", "text")).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["n_bytes"] == 0 and bytes(by[3]["payload"]) == b"\xff" * 576 and by[3]["feature"] == by[4]["feature"]
    assert media.from_media(media.to_media(empty, "doc_id", "text")).count() == 0


# 10 packing


def _packed(rows, texts, capacity):
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids, at = np.array([*_plain(BYTE, t), 1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert np.array_equal(np.frombuffer(r["ids"], "<u4"), ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(windows)


@pytest.mark.parametrize("capacity", [2048, 64, 7])
def test_packing_is_whole_and_tight(documents, texts, capacity):
    rows = packing.pack(documents.coalesce(1), BYTE, 1, capacity).collect()
    n = _packed(rows, texts, capacity)
    assert n == -(-sum(r["length"] for r in rows) // capacity)  # one partition leaves one open window


def test_sum_of_squares_choice():
    """Each placement against all places tried out."""
    rng, capacity = random.Random(11), 40
    p = packing.SumOfSquares(capacity, max_open=10**9)
    counts = Counter()
    for k in range(3000):
        size = rng.choice([rng.randint(1, 39), 13, 20, 27])

        def after(level):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < capacity:
                c[level + size] += 1
            return sum(n * n for n in c.values())

        places = [0, *[level for level in range(1, capacity - size + 1) if counts[level] > 0]]
        least = min(map(after, places))
        level = max(x for x in places if after(x) == least)  # ties: the fullest
        if level:
            counts[level] -= 1
        if level + size < capacity:
            counts[level + size] += 1
        done = list(p.add(k, np.arange(size)))
        assert len(done) == (level + size == capacity)
        assert {i: int(n) for i, n in enumerate(p.count) if n} == {i: n for i, n in counts.items() if n}


def test_open_windows_are_bounded():
    p = packing.SumOfSquares(100, max_open=5)
    rng = random.Random(4)
    out = []
    for k in range(500):
        out += p.add(k, np.arange(rng.randint(1, 99)))
        assert p.open <= 5
    out += p.flush()
    sizes = [sum(len(x[2]) for x in w) for w in out]
    assert max(sizes) <= 100 and sum(s < 100 for s in sizes) <= 1


def test_packing_of_odd_rows(odd, empty):
    rows = packing.pack(odd, BYTE, 1).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}
    assert [r["length"] for r in rows if r["doc_id"] == 3] == [1]
    assert sum(r["length"] for r in rows if r["doc_id"] == 2) == 2 * (len(_plain(BYTE, ROWS[1][1])) + 1)
    assert packing.pack(empty, BYTE, 1).count() == 0


# the pipeline


def test_stages_on_odd_rows(spark, odd, empty):
    for df in (odd, empty):
        docs = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == df.columns, name
            assert out.count() <= docs.count(), name
            docs = shared.cut(out, name)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).columns[0] == "doc_id"


def test_pipeline_against_its_parts(spark, documents, texts):
    got = corpus_pipeline.run(spark, SMALL).collect()
    ids = {r["doc_id"] for r in got}
    assert ids <= set(texts) and len(ids) > len(texts) / 2
    tokens_of = defaultdict(int)
    for r in got:
        tokens_of[r["doc_id"]] += r["length"]
    assert all(r["doc_tokens"] == tokens_of[r["doc_id"]] for r in got)
    # exact copies of a text: at most one is left
    copies = defaultdict(set)
    for i, t in texts.items():
        copies[t].add(i)
    assert all(len(c & ids) <= 1 for c in copies.values())


def test_stages_are_those_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "pack_windows"]
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"
