"""Whole Arrow batches of text as flat numpy arrays: words, lines, per-row sums.

White space is what the word pattern ``[^\\x20\\x09-\\x0D]+`` leaves out. All of it
is ASCII, so words are found on the UTF-8 bytes and nothing is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once. One longer row is a slice of its own.
SLICE_BYTES = 2 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null rows are empty."""
    if pa.types.is_string(values.type) or pa.types.is_binary(values.type):
        values = values.cast(pa.large_binary())
    elif pa.types.is_large_string(values.type):
        values = values.view(pa.large_binary())
    if values.null_count:
        values = values.fill_null(b"")
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, values.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0]))
    return raw, at - at[0]


def slices(batches, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        values = column(batch, text)
        size = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        row = 0
        while row < batch.num_rows:
            done = ends[row - 1] if row else 0
            upto = max(row + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(row, upto - row)
            row = upto


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each of the ranges that ``offsets`` bound."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class Words:
    """The words of a slice of rows, in order, with the row each one belongs to."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets, self.rows = raw, offsets, len(offsets) - 1
        inside = ~WHITE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
        after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
        self.inside = inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)  # each row's first word, and one past the last
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)

    def packed(self, lower: bool = False) -> pa.Array:
        """The words as one binary array."""
        data = self.raw[self.inside]
        if lower:
            data = LOWER[data]
        bounds = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
        )

    def coded(self, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
        """(number of each word, the distinct words)."""
        return coded(self.packed(lower))


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    if len(values) == 0:
        return np.zeros(0, np.int64), values
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte ranges of ``raw`` as a binary array; they are in order and do not overlap."""
    if len(start) == 0:
        return pa.array([], pa.large_binary())
    keep = np.zeros(len(raw) + 1, np.int8)
    np.add.at(keep, start, 1)
    np.add.at(keep, end, -1)
    bounds = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    data = raw[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
    )


def renamed(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """The same equalities with numbers from 0 on, and how many."""
    import pandas as pd

    out, names = pd.factorize(codes)
    return out.astype(np.int64), len(names)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct numbers, sorted. Sorting beats the hash table of np.unique by far."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def grouped(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the rows of a table in each of the ranges that ``offsets`` bound."""
    out = np.zeros((len(offsets) - 1, values.shape[1]))
    real = np.flatnonzero(np.diff(offsets))
    if len(real):
        out[real] = np.add.reduceat(values, offsets[:-1][real], axis=0, dtype=np.float64)
    return out


def code_points(raw: np.ndarray) -> np.ndarray:
    """Whether each byte begins a code point."""
    return (raw & 0xC0) != 0x80


def lowered(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the lower-cased values, offsets); bytes that are no UTF-8 become U+FFFD."""
    raw, offsets = flat(values)
    try:
        text = raw.tobytes().decode()
        begins = np.concatenate([[0], np.cumsum(code_points(raw))])
        bounds = begins[offsets]
    except UnicodeDecodeError:
        parts = [raw[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        text = "".join(parts)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return lower_table()[points], bounds


_TABLES: dict[str, np.ndarray] = {}


def lower_table() -> np.ndarray:
    """Lower-case form of each code point that has one of a single code point."""
    if "lower" not in _TABLES:
        table = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x1E944):  # no case beyond
            low = chr(i).lower()
            if len(low) == 1:
                table[i] = ord(low)
        _TABLES["lower"] = table
    return _TABLES["lower"]


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    if "letter" not in _TABLES:
        _TABLES["letter"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _TABLES["letter"]
