"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered as one string: every turn is its role, a control string, its text and the control string
again. The control string is a special token of the vocabulary, so no token crosses the edge of a text, and an escape
keeps texts and roles from spelling it. The string is encoded once with offsets. Turn spans and token spans are both
sorted, so the tokens of a turn are a slice found by two binary searches.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import arrow_map, tuned
from spendlake.llm.tokens import vocabulary_path

CONTROL = "<|endoftext|>"
LEARNED = ("assistant",)
#: A backslash stands before a backslash and, inside what would open a control string, before the bar.
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and where each turn's escaped text stands in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{escape(role)}{CONTROL}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CONTROL]
        at = spans[-1][1] + len(CONTROL)
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns a rendered string was made from."""
    parts = text.split(CONTROL)
    if parts.pop() or len(parts) % 2:
        raise ValueError("not a rendered conversation")
    return [(unescape(a), unescape(b)) for a, b in zip(parts[::2], parts[1::2])]


def token_slices(starts: np.ndarray, stops: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each span the tokens that touch it, as slices; token and span bounds ascend.

    A token without width touches no span.
    """
    edges = np.array(spans, dtype=np.int64).reshape(-1, 2)
    first = np.searchsorted(stops, edges[:, 0], side="right")
    last = np.searchsorted(starts, edges[:, 1], side="left")
    return [(int(a), int(max(a, b)) if e > s else int(a)) for a, b, (s, e) in zip(first, last, spans)]


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_OUT = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())),
     ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_()))]
)


def _format(batches, path, learned):
    tokenizer = _tokenizer(path)
    for batch in batches:
        rows, size = [], 0
        for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1)):
            turns = [(t["role"], t["text"]) for t in turns.as_py()]
            text, spans = render(turns)
            e = tokenizer.encode(text, add_special_tokens=False)
            edges = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
            mask = np.zeros(len(edges), dtype=bool)
            wanted = [s for s, (role, _) in zip(spans, turns) if role in learned]
            for a, b in token_slices(edges[:, 0], edges[:, 1], wanted):
                mask[a:b] = True
            rows.append((conv, len(turns), text, e.ids, edges[:, 0], edges[:, 1], mask))
            size += len(text) + 13 * len(mask)
            if size > 8 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows), _OUT)], schema=_OUT)


def formatted(turns: DataFrame, path: str | None = None, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, ids, starts, stops, mask``.

    ``ids`` are tokens of the rendered string, ``starts`` and ``stops`` their places in it in code points, ``mask``
    the tokens of the texts of ``learned`` roles. Turns are ordered by number, then role and text; a null number comes
    first, null roles and texts are empty. Repeated rows are turns of their own, rows without a conversation id form
    one, other columns are not read and an empty table gives no rows. A conversation is rendered whole, in one task.
    """
    tuned(turns.sparkSession)
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    schema = "conv_id long, n_turns long, formatted string, ids array<int>, starts array<int>, stops array<int>, mask array<boolean>"
    return arrow_map(whole, partial(_format, path=path or vocabulary_path(), learned=learned), schema)


_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _digests(batches, path):
    import hashlib

    tokenizer = _tokenizer(path)
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            # Everything comes from the ids and the mask; the offsets say which text a masked token stands for.
            text = tokenizer.decode(row["ids"], skip_special_tokens=False)
            turns = parse(text)
            masked, at, loss = np.flatnonzero(row["mask"]), 0, []
            for k in np.split(masked, np.flatnonzero(np.diff(masked) > 1) + 1) if len(masked) else []:
                a, b = max(at, row["starts"][k[0]]), row["stops"][k[-1]]
                loss.append(unescape(text[a:b]))
                at = b
            loss = "".join(loss)
            said = "".join(f"{role}\n{words}\n" for role, words in turns)
            sha = [hashlib.sha256(v.encode()).hexdigest() for v in (said, loss)]
            rows.append((row["conv_id"], len(turns), sha[0], len(loss), sha[1], len(text)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows), _DIGEST)], schema=_DIGEST)


def digests(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, decoded from ids and masks."""
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return arrow_map(rows, partial(_digests, path=path or vocabulary_path()), out)
