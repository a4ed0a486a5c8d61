"""Token-level loss masks: what of a chat is learnt, token by token, when its text is cut from the left to a length.

A tokenizer gives each token the characters that it stands for; a token is learnt if it begins within an answer. Rows that
are too long lose their beginning, as what they teach stands at the end, and keep the mask of the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.render import chat_text, loss_spans

#: Rows that a worker holds at a time.
ROWS = 200


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def learnt(starts: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens begin within one of the spans (ordered, apart, ends exclusive)."""
    edges = np.array(spans, dtype=np.int64).reshape(-1, 2)
    at = np.searchsorted(edges[:, 0], starts, side="right") - 1
    return (at >= 0) & (starts < edges[np.maximum(at, 0), 1]) if len(edges) else np.zeros(len(starts), dtype=bool)


def masked(ids: np.ndarray, starts: np.ndarray, spans: list[tuple[int, int]], end: int | None, ends_learnt: bool, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last `most` of a row's ids with their first characters and mask. end: an id that closes the row; it is learnt if the
    last message is, and has no character, so that its place is -1."""
    mask = learnt(starts, spans)
    if end is not None and (not len(ids) or ids[-1] != end):
        ids, starts, mask = np.append(ids, end), np.append(starts, -1), np.append(mask, ends_learnt)
    first = max(len(ids) - most, 0)
    return ids[first:], starts[first:], mask[first:]


def _encoded(path: str, end: int | None, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for whole in batches:
            for top in range(0, max(whole.num_rows, 1), ROWS):
                batch = whole.slice(top, ROWS)
                text, spans, last = (batch.column(batch.num_columns - k).to_pylist() for k in (3, 2, 1))
                out = []
                for row, own, learns in zip(tokenizer.encode_batch([t or "" for t in text], add_special_tokens=False), spans, last, strict=True):
                    ids = np.array(row.ids, dtype=np.int64)
                    starts = np.array([a for a, _ in row.offsets], dtype=np.int64)
                    kept = masked(ids, starts, [(s["start"], s["end"]) for s in own or ()], end, bool(learns), most)
                    out.append((len(ids) + (end is not None and (not len(ids) or ids[-1] != end)), *kept))
                arrays = [pa.array([o[0] for o in out], pa.int64())]
                for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.bool_())):
                    arrays.append(pa.array([o[k] for o in out], pa.list_(kind)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *arrays], [*batch.schema.names[:-3], *NAMES])

    return run


NAMES = ("n_tokens", "ids", "at", "learnt")


def loss_mask(rows: DataFrame, keys: list[str], messages: Column, tokenizer: str, most: int, end: int | None = None) -> DataFrame:
    """The keys with n_tokens (of the whole chat), and of its last `most` tokens ids, at (their first characters in chat_text)
    and learnt.

    tokenizer: a file of the tokenizers library that every node has. Defined cases: no or null messages give the closing id
    alone, or nothing; null contents are empty; a token that begins within an answer is learnt whole.
    """
    held = F.transform(F.coalesce(messages, F.array().cast("array<struct<role:string,content:string>>")), lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    said = F.col("_m")
    last = F.coalesce(F.try_element_at(said, F.lit(-1))["role"] == "assistant", F.lit(False))
    plain = rows.select(*keys, held.alias("_m")).select(*keys, chat_text(said).alias("_text"), loss_spans(said).alias("_spans"), last.alias("_last"))
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keys)
    return plain.mapInArrow(_encoded(tokenizer, end, most), kinds + "n_tokens long, ids array<long>, at array<long>, learnt array<boolean>")

