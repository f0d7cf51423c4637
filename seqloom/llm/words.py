"""Words and word shingles of whole Arrow batches, as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20_240_601)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_SLAB = 1 << 16
_POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_SLAB, _BASE, np.uint64))])
_INVERSE = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_SLAB, pow(_BASE, -1, 2**64), np.uint64))])


def mixed(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; null as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each span of bytes; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + _SLAB, "right")))
        size = int(ends[j - 1] - at)
        powers, inverse = _POWERS, _INVERSE
        if size > _SLAB:  # one word longer than a slab
            powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE, np.uint64))])
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[data[at : at + size]] * powers[:size], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    lengths = (ends - starts).astype(np.uint64)
    return mixed(out + lengths * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z as a-z) and, for each text, where its words begin in them (one more at the end)."""
    data, offsets = _flat(texts)
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_GAP[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[offsets] = False  # a text's first word begins anew
    starts = np.flatnonzero(inside & ~before)
    goes_on = np.zeros(len(data) + 1, bool)
    goes_on[:-1] = inside[1:]
    goes_on[np.maximum(offsets - 1, 0)[1:]] = False
    ends = np.flatnonzero(inside & ~goes_on) + 1
    return _hash_spans(data, starts, ends), np.searchsorted(starts, offsets)


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most_bytes`` of text each, and one text at least."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(np.diff(_flat(batch[column])[1]))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``k`` words, sorted; a shorter text is one shingle, one without words none."""
    words, at = word_hashes(texts)
    factors = [np.uint64(pow(0xC2B2AE3D27D4EB4F, i + 1, 2**64)) for i in range(k)]
    whole = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i, f in enumerate(factors):
        whole += words[i : i + len(whole)] * f
    whole = mixed(whole)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1])
        elif b > a:
            short = sum((int(w) * int(f) for w, f in zip(words[a:b], factors)), b - a) % 2**64
            yield mixed(np.array([short], np.uint64))
        else:
            yield np.empty(0, np.uint64)
