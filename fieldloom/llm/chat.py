"""Chat formatting with loss masks aligned by offsets.

A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``. In roles and texts ``<|`` becomes
``<!|``, ``<!|`` becomes ``<!!|`` and so on, so that no control string stands in a text
and the escape can be undone. A conversation is rendered as a whole and encoded once,
with character offsets; the sorted spans of the trained role's texts are intersected
with the tokens' spans by binary search. The control strings are added to the tokenizer
as special tokens, so no token reaches over a span's end.

A conversation is one row of text, as a document is, and is rendered in one task; its turns
are gathered by conversation, no further.

Defined results: a null text or role is an empty one; turns are ordered by number (null
first), ties by role, then text; repeated rows are turns each; a row with a null
conversation id is a conversation of its own, as nothing says which others it goes with;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(!*)\|"), re.compile(r"<!(!*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<!\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of the trained role's escaped texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        before, body = f"{START}{escape(role)}{SEP}", escape(text)
        out += [before, body, END]
        at += len(before)
        if role == trained and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn.removeprefix(START).partition(SEP)
        turns.append((unescape(role), unescape(text)))
    return turns


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens meet a span; spans are sorted and disjoint."""
    if not spans:
        return np.zeros(len(starts), bool)
    first, last = np.array(spans).T
    i = np.searchsorted(last, starts, side="right")
    return (i < len(spans)) & (ends > np.append(first, np.iinfo(np.int64).max)[i])


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, chosen: np.ndarray) -> list[str]:
    """The unescaped texts under a mask: one per run of chosen tokens that follow each other.

    Tokens of one character's bytes share its span, so spans are merged first.
    """
    s, e = starts[chosen], ends[chosen]
    if not len(s):
        return []
    e = np.maximum.accumulate(e)
    cuts = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    stop = np.r_[cuts[1:], len(s)] - 1
    return [unescape(formatted[a:b]) for a, b in zip(s[cuts].tolist(), e[stop].tolist())]


def format_conversations(turns: DataFrame, tokenizer_file: str, trained: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, ids, starts, ends, mask``; the
    offsets are code points in ``formatted``."""
    each = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = turns.select("conv_id", each.alias("t"))
    rows = said.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rows = rows.union(said.where("conv_id IS NULL").select("conv_id", F.array("t")))
    rows = rows.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.add_special_tokens([START, SEP, END])
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                done = [render(list(zip(r.as_py(), t.as_py())), trained) for r, t in zip(part.column(1), part.column(2))]
                ids, starts, ends, masks = [], [], [], []
                for text, spans in done:
                    e = tokenizer.encode(text, add_special_tokens=False)
                    at = np.array(e.offsets, np.int64).reshape(-1, 2)
                    ids.append(np.array(e.ids, np.int32))
                    starts.append(at[:, 0])
                    ends.append(at[:, 1])
                    masks.append(mask(at[:, 0], at[:, 1], spans))
                lists = [pa.array(x, pa.list_(pa.int32())) for x in (ids, [x.astype(np.int32) for x in starts], [x.astype(np.int32) for x in ends])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x for x, _ in done], pa.string()), *lists, pa.array(masks, pa.list_(pa.bool_()))],
                    names=["conv_id", "formatted", "ids", "starts", "ends", "mask"],
                )

    kind = turns.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>")


def digests(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts as read back from ``format_conversations``' output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            rows = []
            for text, starts, ends, chosen in zip(*(batch.column(i) for i in range(1, 5))):
                text = text.as_py()
                turns = parse(text)
                a, b, c = (np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in (starts, ends, chosen))
                loss = "".join(masked_texts(text, a, b, c.astype(bool)))
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((len(turns), sha256(told.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema["conv_id"].dataType.simpleString()
    slim = formatted.select("conv_id", "formatted", "starts", "ends", "mask")
    return slim.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
