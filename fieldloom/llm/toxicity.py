"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier over hashed words and word beginnings, each weighed by its
share of the text's words. It is trained from confirmed toxic texts (P) and unlabelled
text (U), whose toxic share ``prior`` is known. Features take part whose frequency among
the texts of P differs from that of U by ``min_z`` standard errors or more; all others
would be noise. With the logistic loss l, the risk is

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

in mini-batches by Adam; where a batch makes the second term negative, the step goes
up that term, which keeps the classifier from explaining U away.

Training is on the driver over a bounded sample; the model is one table of fixed size,
which goes to the executors with the code. Each text is scored whole, alone.

Defined results: a null or empty text, and one without letters, has the score of the bias
alone; equal texts have equal scores; repeated rows and null ids are kept; where no feature
separates P from U, all scores are that of the bias; without a toxic example every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[^\W\d_]+")
#: A feature's value is its share of the words times this.
SCALE = 50.0
#: Logits are cut off here, so that a few extreme texts don't rule the risk.
CLIP = 6.0
#: Words kept in memory at once.
CACHE_WORDS = 1 << 18


def word_features(word: str, buckets: int) -> list[int]:
    """The hashed word and its beginnings of four to six letters."""
    found = {zlib.crc32(b"w" + word.encode("utf-8", "replace")) % buckets}
    for n in (4, 5, 6):
        if len(word) > n:
            found.add(zlib.crc32(b"p" + word[:n].encode("utf-8", "replace")) % buckets)
    return sorted(found)


def words(text: str | None) -> Iterator[str]:
    """Lower-cased words, one by one."""
    return (m.group().lower() for m in _WORD.finditer(text or ""))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "known": {}}

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -CLIP, CLIP)))) if len(self.weights) else 0.0

    def logit(self, text: str | None) -> float:
        known, total, n = self.known, 0.0, 0
        for word in words(text):
            w = known.get(word)
            if w is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                w = known[word] = float(self.weights[word_features(word, len(self.weights))].sum())
            total += w
            n += 1
        return self.bias + (SCALE * total / n if n else 0.0)


class _Sparse:
    """Texts as rows of distinct features and their values."""

    def __init__(self, texts: list[str], buckets: int):
        known: dict[str, list[int]] = {}
        feats, values, sizes = [], [], []
        for text in texts:
            found = list(words(text))
            for w in found:
                if w not in known:
                    known[w] = word_features(w, buckets)
            f, c = np.unique(np.array([x for w in found for x in known[w]], np.int64), return_counts=True)
            feats.append(f)
            values.append(c * (SCALE / max(1, len(found))))
            sizes.append(len(f))
        self.n = len(texts)
        self.rows = np.repeat(np.arange(self.n), sizes)
        self.feats, self.values = np.concatenate(feats), np.concatenate(values)
        self.frequency = np.bincount(self.feats, minlength=buckets)

    def keep(self, place: np.ndarray) -> None:
        """Only the features with a place, renamed to it."""
        used = place[self.feats] >= 0
        self.rows, self.values = self.rows[used], self.values[used]
        self.feats = place[self.feats[used]]
        ends = np.searchsorted(self.rows, np.arange(self.n), side="right")
        self.ends, self.starts = ends, np.r_[0, ends[:-1]]

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some rows: which row, feature and value of each entry."""
        size = self.ends[rows] - self.starts[rows]
        row = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[rows], size)
        return row, self.feats[at], self.values[at]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The non-negative risk of logits of P and U."""
    rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return prior * np.logaddexp(0, -zp).mean() + max(0.0, rest)


def pull(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The direction against which a step moves the logits: the gradient of ``risk``, or, where
    its second term is negative, minus the gradient of that term."""
    rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    if rest >= 0:
        return np.full(len(zp), -prior / len(zp)), _sigmoid(zu) / len(zu)
    return prior * _sigmoid(zp) / len(zp), -_sigmoid(zu) / len(zu)


def train(
    toxic: list[str],
    unlabelled: list[str],
    prior: float,
    buckets: int = 1 << 18,
    steps: int = 1200,
    batch: int = 128,
    rate: float = 0.05,
    decay: float = 1e-3,
    min_z: float = 5.0,
    seed: int = 11,
) -> Model:
    """The classifier; every fourth text is kept to fit the scale and bias of its scores."""
    if not toxic or not unlabelled:
        return Model(np.zeros(0), 0.0)
    rng = np.random.default_rng(seed)
    few = len(toxic) < 8 or len(unlabelled) < 8
    kept_p, kept_u = (toxic, unlabelled) if few else (toxic[3::4], unlabelled[3::4])
    if not few:
        toxic, unlabelled = ([t for i, t in enumerate(x) if i % 4 != 3] for x in (toxic, unlabelled))
    p, u = _Sparse(toxic, buckets), _Sparse(unlabelled, buckets)
    both = (p.frequency + u.frequency) / (p.n + u.n)
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / p.n + 1 / u.n))
    z = (p.frequency / p.n - u.frequency / u.n) / error
    used = np.flatnonzero((np.abs(z) >= min_z) & (p.frequency + u.frequency > 2))
    size = len(used)
    place = np.full(buckets, -1)
    place[used] = np.arange(size)
    p.keep(place)
    u.keep(place)
    w, m, v = (np.zeros(size + 1) for _ in range(3))  # the last is the bias
    share_p, share_u = (p.frequency[used] + 0.5) / (p.n + 1), (u.frequency[used] + 0.5) / (u.n + 1)
    w[:-1] = np.log(share_p / share_u)  # a start that the frequencies suggest
    w[-1] = np.log(max(prior, 1e-6))
    for k in range(1, steps + 1):
        parts = []
        for data in (p, u):
            rows = rng.integers(data.n, size=min(batch, 4 * data.n))
            row, f, x = data.take(rows)
            z = np.bincount(row, x * w[f], minlength=len(rows)) + w[-1]
            parts.append((row, f, x, np.clip(z, -CLIP, CLIP), np.abs(z) < CLIP))
        (prow, pf, px, pz, pin), (urow, uf, ux, uz, uin) = parts
        gp, gu = pull(pz, uz, prior)
        gp, gu = gp * pin, gu * uin
        g = np.zeros(size + 1)  # no feature may have passed; the bias is learned all the same
        g += np.bincount(pf, px * gp[prow], minlength=size + 1)
        g += np.bincount(uf, ux * gu[urow], minlength=size + 1)
        g[-1] = gp.sum() + gu.sum()
        g[:-1] += decay * w[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = rate * min(1.0, 2 * (1 - k / (steps + 1)))
        w -= step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    weights = np.zeros(buckets, np.float32)
    weights[used] = w[:-1]
    raw = Model(weights, float(w[-1]))
    scale, shift = _calibrated(*(np.array([raw.logit(t) for t in x]) for x in (kept_p, kept_u)), prior)
    return Model((weights * scale).astype(np.float32), float(w[-1] * scale + shift))


def _calibrated(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The scale and shift of logits with the least non-negative risk; a search of two numbers."""
    best = (np.inf, 1.0, 0.0)
    for scale in np.geomspace(0.5, 16, 24):
        for shift in np.linspace(-24, 24, 97):
            p, u = (np.clip(scale * z + shift, -CLIP, CLIP) for z in (zp, zu))
            found = risk(p, u, prior)
            if found < best[0] - 1e-9:
                best = (found, float(scale), float(shift))
    return best[1:]


def sample(
    docs: DataFrame, labels: DataFrame, learnable: Column, max_toxic: int = 2000, max_unlabelled: int = 6000, max_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[list[str], list[str], float]:
    """Bounded samples by a hash of the id: texts labelled toxic, texts whatever their label,
    and the toxic share of the labelled rows. ``learnable`` is over ``id_col``."""
    space = 1 << 32
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(space))
    known = labels.where(learnable & F.col("toxic").isNotNull())
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("toxic") > 0, 1)), F.lit(0))).first()
    if not toxic:
        return [], [], 0.0
    chosen = known.where((F.col("toxic") > 0) & (place < space * max_toxic // toxic)).select(id_col).distinct().limit(2 * max_toxic)
    ids = sorted(r[0] for r in chosen.collect() if r[0] is not None)
    texts = docs.where(learnable & F.col(text_col).isNotNull() & (F.length(text_col) <= max_chars))
    rows = docs.where(learnable).count()
    among = F.pmod(F.xxhash64(F.lit("u"), F.col(id_col).cast("string")), F.lit(space)) < space * max_unlabelled // max(1, rows)
    marked = texts.select(F.coalesce(F.col(id_col).isin(ids), F.lit(False)).alias("p"), among.alias("u"), F.col(text_col).alias("text")).where("p OR u").limit(4 * (max_toxic + max_unlabelled))
    found = sorted(tuple(r) for r in marked.collect())
    return [t for p, _, t in found if p], [t for _, u, t in found if u], toxic / n


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, **bounds) -> Model:
    """A classifier from the rows where ``learnable`` holds; ``bounds``: those of ``sample``."""
    return train(*sample(docs, labels, learnable, **bounds))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score``; only the text is an input."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([model.score(x.as_py()) for x in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
