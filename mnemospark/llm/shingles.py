"""Words, word windows and sliding minima over numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import common

U64 = np.uint64
#: Bytes of text hashed in one go.
CHUNK = 1 << 20


def words(text: str | None) -> list[bytes]:
    """What stands between spaces and the characters 9 to 13, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def window_hashes(parts: list[bytes], k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words; of all words as one if there are fewer, none without words."""
    if not parts:
        return np.empty(0, dtype=np.uint64)
    k = min(k, len(parts))
    out, first = [], 0
    while first + k <= len(parts):
        size, last = 0, first
        while last < len(parts) and (size < CHUNK or last < first + k):
            size += len(parts[last]) + 1
            last += 1
        data = np.frombuffer(b" ".join(parts[first:last]), dtype=np.uint8)
        # The words' lengths give their places; a space stands between any two.
        ends = np.cumsum(np.fromiter(map(len, parts[first:last]), dtype=np.int64, count=last - first) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        out.append(common.span_hash(common.prefix_hash(data), starts[: len(starts) - k + 1], ends[k - 1 :]))
        if last == len(parts):
            break
        first = last - k + 1
    return np.concatenate(out)


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, the place of its smallest (the first of equals, by the top 40 bits)."""
    n = len(values) - w + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    if len(values) >= 1 << 24:
        raise ValueError("too many values at once")
    keys = (values & ~U64((1 << 24) - 1)) | np.arange(len(values), dtype=np.uint64)
    padded = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & U64((1 << 24) - 1)).astype(np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(values):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(values)]))


def groups_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cuts a list into runs whose sizes add up to `most` or so; a larger item stands alone."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)
