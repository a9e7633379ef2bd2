"""Arrow text columns as flat byte arrays for numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, offsets (n + 1) into them, and which are null (of no bytes)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    null = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    column = column.fill_null("") if null.any() else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        at = np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0], null


def pieces(batch: pa.RecordBatch, column: int, limit: int, most: int = 1024) -> list[pa.RecordBatch]:
    """The batch cut into runs of at most `most` rows with about `limit` bytes of text each; a longer text is a run of its own."""
    out, start = [], 0
    _, at, _ = flat(batch.column(column))
    while start < batch.num_rows:
        end = int(np.searchsorted(at, at[start] + limit, "right")) - 1
        end = min(max(end, start + 1), start + most, batch.num_rows)
        out.append(batch.slice(start, end - start))
        start = end
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, or more, of an odd number modulo 2**64, and of its inverse."""
    if not len(_powers) or len(_powers["up"]) < n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, x in (("up", _ODD), ("down", inverse)):
                p = np.full(max(n, 1 << 19), x, np.uint64)
                p[0] = 1
                _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in turn, and where each text's begin (n + 1 places).

    A-Z count as a-z; words are parted by ASCII white space.
    """
    body, at, _ = flat(column)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    body = lower[body]
    gap = np.zeros(256, bool)
    gap[[9, 10, 11, 12, 13, 32]] = True
    space = gap[body]
    first = np.zeros(len(body) + 1, bool)
    first[at[:-1]] = True
    first = first[:-1]
    before = np.concatenate([[True], space[:-1]]) | first if len(body) else space
    starts = np.flatnonzero(~space & before)
    after = np.concatenate([space[1:] | first[1:], [True]]) if len(body) else space
    ends = np.flatnonzero(~space & after) + 1
    up, down = powers(len(body) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: len(body)], dtype=np.uint64)])
        words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
