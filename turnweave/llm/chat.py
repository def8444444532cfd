"""Chat formatting with an exact loss mask.

A conversation is rendered whole and encoded once, with character offsets. The mask comes from intersecting the sorted
token spans with the sorted spans of assistant texts by binary search. Marks are special tokens, so no token
crosses from a mark into a text. Control strings inside texts and roles are escaped reversibly: every "<", any
number of "~", "|" gets one "~" more, so nothing but the template writes "<|".
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(~*)\|"), re.compile(r"<~(~*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END), re.DOTALL)
_loaded: dict = {}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<~\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the span of every assistant text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted conversation was rendered from."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def read_loss(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The text under the loss mask, unescaped; tokens of one character's bytes share its span."""
    a, b = starts[mask], ends[mask]
    if not len(a):
        return ""
    far = np.maximum.accumulate(b)
    fresh = np.append(True, a[1:] > far[:-1])
    past = np.append(far[:-1][fresh[1:]], far[-1])
    return "".join(unescape(formatted[lo:hi]) for lo, hi in zip(a[fresh].tolist(), past.tolist(), strict=True))


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that meet a span, by binary search of the sorted token spans."""
    mask = np.zeros(len(starts), dtype=bool)
    if spans:
        a, b = np.array(spans).T
        for lo, hi in zip(np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left"), strict=True):
            mask[lo:hi] = True
    return mask


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer, pre_tokenizers, processors

        t = Tokenizer.from_file(path)
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        t.post_processor = processors.ByteLevel(trim_offsets=False)
        t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, MIDDLE, END)])
        _loaded[path] = t
    return _loaded[path]


_FORMATTED = "conv_id long, formatted string, tokens array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def formatted(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per conv_id: formatted text, token ids, their character spans and the loss mask.

    Turns go in order of turn (null first), then role and text. A null text or role is empty; a row without conv_id
    is a conversation by itself; repeated rows are repeated turns. A conversation is one training example and stays in one row; an empty
    table gives none. ``tokenizer`` is a byte-level vocabulary that every executor can open.
    """
    turn = F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("x"))
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("turns"))
    whole = whole.unionByName(rows.where("conv_id is null").select("conv_id", F.array("x").alias("turns")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rendered = [render([(x["role"], x["text"]) for x in turns]) for turns in part.column("turns").to_pylist()]
                rows = []
                for e, (_, spans) in zip(t.encode_batch([r[0] for r in rendered], add_special_tokens=False), rendered, strict=True):
                    n = len(e)
                    at = np.fromiter(chain.from_iterable(e.offsets), np.int32, 2 * n).reshape(-1, 2)
                    rows.append((np.fromiter(e.ids, np.int32, n), at[:, 0], at[:, 1], loss_mask(at[:, 0], at[:, 1], spans)))
                edges = pa.array(np.cumsum([0, *(len(r[0]) for r in rows)]), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate([r[i] for r in rows]))) for i in range(4)]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array([r[0] for r in rendered], pa.string()), *lists], ["conv_id", "formatted", "tokens", "starts", "ends", "loss"])

    return whole.mapInArrow(encode, _FORMATTED)


def digests(rows: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns and loss text, as counts and digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = batch.column("formatted").to_pylist()
            for i, text in enumerate(texts):
                turns = read_turns(text)
                loss = read_loss(text, *(batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("starts", "ends", "loss")))
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array([r[j] for r in out], k) for j, k in enumerate(kinds))], ["conv_id", *names])

    return rows.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
