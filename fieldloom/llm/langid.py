"""Language identification by averaged hashed subword embeddings.

A text's features are the byte 3- and 4-grams of its lower-cased words (with their
edges), hashed. Each feature has an embedding; their mean goes through a linear softmax.
Both are trained by stochastic gradient descent in numpy, on the driver, over a
bounded sample. As the model is linear, a trained model is one table of
features by languages, which goes to the executors (its size is fixed by ``buckets``).

Calibration: on sampled rows kept out of training, over excerpts of many lengths, one
temperature makes the probabilities fit, and the rejection threshold is the greatest
one that rejects at most ``reject_share`` of the excerpts that are predicted rightly.

Defined results: a null text or one without a letter is ``und``, score 0, rejected;
a text whose language was never learned gets the likeliest learned one and a low score;
equal texts have equal results; repeated rows and null ids are kept; without any labelled
row every text is ``und``; an empty table gives no rows; other columns are ignored by
``predict`` and kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.shared import release_memory

UNDETERMINED = "und"
#: Bytes of text whose features are in memory at once.
SLAB = 1 << 19
_SEPARATE = bytes(i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def features(text: str, buckets: int) -> np.ndarray:
    """Hashed byte 3- and 4-grams that lie within a word and its edges."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_SEPARATE) + b" ", np.uint8).astype(np.uint32)
    gap = b == 32
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
    three = h[~gap[1:-1]]
    four = (h[:-1] * np.uint32(31) + b[3:] * np.uint32(0x27D4EB2F))[~(gap[1:-2] | gap[2:-1])]
    h = np.concatenate([three, four])
    return ((h ^ (h >> np.uint32(15))) & np.uint32(buckets - 1)).astype(np.int32)


def _slabs(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLAB:
        end = text.rfind(" ", at, at + SLAB) + 1 or at + SLAB
        yield text[at:end]
        at = end
    yield text[at:]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    """``table``: a feature's share of each language's logit."""

    languages: list[str]
    table: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for part in _slabs(text):
            f = features(part, len(self.table))
            n += len(f)
            total += np.bincount(f, minlength=len(self.table)) @ self.table
        return total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        p = _softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _excerpts(text: str, rng: np.random.Generator) -> list[str]:
    """The whole text, and stretches of its words of several lengths."""
    words = text.split()
    out = [text]
    for n in (4, 12, 40):
        if len(words) > n:
            at = int(rng.integers(len(words) - n))
            out.append(" ".join(words[at : at + n]))
    return out


def train(
    texts: list[str],
    langs: list[str],
    buckets: int = 1 << 14,
    dim: int = 16,
    epochs: int = 3,
    rate: float = 0.5,
    reject_share: float = 0.001,
    seed: int = 7,
) -> Model:
    """A calibrated model; every fifth text is kept for calibration."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((buckets, 0)))
    parts: tuple[list, list] = ([], [])
    for i, (text, lang) in enumerate(zip(texts, langs)):
        for x in _excerpts(text, rng):
            f, n = np.unique(features(x, buckets), return_counts=True)
            if len(f):
                parts[i % 5 == 4].append((f, (n / n.sum()).astype(np.float32), names.index(lang)))
    learn, check = parts
    embed = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (dim, len(names))).astype(np.float32)
    steps, k = epochs * len(learn), 0
    for _ in range(epochs):
        for j in rng.permutation(len(learn)):
            f, w, y = learn[j]
            now = rate * (1 - k / steps)
            k += 1
            mean = w @ embed[f]
            g = _softmax(mean @ out)
            g[y] -= 1
            back = out @ g
            out -= now * np.outer(mean, g)
            embed[f] -= (now * len(f) ** 0.5) * np.outer(w, back)
    model = Model(names, (embed @ out).astype(np.float64))
    if check:
        z = np.stack([w @ model.table[f] for f, w, _ in check])
        y = np.array([c for *_, c in check])
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
        if len(right):
            model.threshold = float(right[int(len(right) * reject_share)])
    return model


def sample(
    docs: DataFrame, learnable: Column, per_lang: int = 400, max_chars: int = 20_000, max_langs: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled rows: about ``per_lang`` rows (at most twice that) for each of the
    ``max_langs`` commonest languages, of texts up to ``max_chars``, by a hash of the id."""
    rows = docs.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(max_langs).collect()
    if not counts:
        return [], []
    space = 1 << 32
    limit = F.lit(0)
    for r in counts:
        limit = F.when(F.col(lang_col) == r[lang_col], F.lit(min(space, space * per_lang // r["count"]))).otherwise(limit)
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(space))
    chosen = rows.where((place < limit) & (F.length(text_col) <= max_chars))
    chosen = chosen.select(F.col(lang_col).alias("lang"), place.alias("place"), F.col(text_col).alias("text")).limit(2 * per_lang * len(counts))
    found = sorted(tuple(r) for r in chosen.collect())
    return [r[2] for r in found], [r[0] for r in found]


def fit(docs: DataFrame, learnable: Column, **bounds) -> Model:
    """A model of the rows where ``learnable`` holds; ``bounds``: those of ``sample``."""
    return train(*sample(docs, learnable, **bounds))


def _scored(rows: DataFrame, model: Model, text_col: str, keep: list[str]) -> DataFrame:
    """``keep``'s columns, then ``lang_pred, score, rejected``."""
    schema = T.StructType([rows.schema[c] for c in keep])
    schema = schema.add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("rejected", T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = [pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 3, (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return rows.select(*keep, F.col(text_col)).mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected``; only the text is an input."""
    return _scored(docs, model, text_col, [id_col])


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, all columns."""

    @F.arrow_udf("boolean")
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([not model.predict(x.as_py())[2] for x in texts], pa.bool_())
        release_memory()

    return docs.where(kept(F.col(text_col)))
