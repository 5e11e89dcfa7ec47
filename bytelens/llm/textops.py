"""Vectorised text kernels over Arrow string buffers (numpy only, no per-character Python)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer document is a slice of its own.
SLICE = 1 << 18
#: Longer words are hashed one by one.
LONG_WORD = 256
#: A-Z to a-z, any other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The first 0 to 8 bytes of an octet.
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a uint64 hash over all its bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i <= n, modulo 2**64."""
    have = max(_POWERS, default=0)
    if have <= n:
        have = max(SLICE + 1, 1 << int(n).bit_length())
        _POWERS.clear()
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(have, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[have] = (both[0], both[1])
    return _POWERS[have]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, budget: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `budget` bytes, of one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + budget, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def part(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    return data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def class_of(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table of the 256 byte values that is False on the given inclusive ranges."""
    out = np.ones(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = False
    return out


#: Words are runs of anything but ASCII white space.
NOT_SPACE = class_of([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of ASCII letters and digits and of anything outside ASCII.
ALNUM = class_of([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; no word crosses a row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = is_word[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = w[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = w[1:]
    after[inner - 1] = False
    return np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1


def word_counts(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    starts, _ = word_spans(data, offsets, is_word)
    return np.diff(np.searchsorted(starts, offsets))


def octets(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on as one number; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums over positions of a scrambled value of the 8 bytes from there on, times BASE**position.

    A polynomial of bytes modulo 2**64 gives some different strings one hash, whatever its base; one
    of scrambled octets has no such structure.
    """
    n = len(data)
    v = octets(data)[:n] * np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xA0761D6478BD642F)
    v ^= v >> np.uint64(29)
    v *= powers(n)[0][:n]
    out = np.empty(n + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(v, out=out[1:])
    return out


def span_sums(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """What the bytes of spans of 8 bytes or more add up to, wherever they stand; not yet mixed."""
    return (sums[hi - 7] - sums[lo]) * powers(len(sums))[1][lo]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of words, 8 bytes a step; of words beyond `LONG_WORD` bytes by BLAKE2."""
    size = (ends - starts).astype(np.uint64)
    h = mix(size * np.uint64(BASE) + np.uint64(seed))
    views = octets(data)
    at, live = starts, None
    while len(at):
        rest = size if live is None else size[live] - done
        piece = views[at] & MASKS[np.minimum(rest, np.uint64(8)).astype(np.int64)]
        if live is None:
            h = mix(h ^ piece)
            live, done = np.flatnonzero((rest > 8) & (rest <= LONG_WORD)), np.uint64(0)
        else:
            h[live] = mix(h[live] ^ piece)
            live = live[rest > 8]
        done += np.uint64(8)
        at = starts[live] + np.int64(done)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        h[i] = int.from_bytes(digest.digest(), "little")
    return h


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, seed: int):
    """Hashes of all words with A-Z as a-z, their starts and ends, and the index of each row's first word."""
    starts, ends = word_spans(data, offsets, is_word)
    return word_hashes(LOWER[data], starts, ends, seed), starts, ends, np.searchsorted(starts, offsets)


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all k consecutive words, windows across rows included (mask them with `inside`)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed)) | np.uint64(1)
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out += h[j : j + n] * factors[j]
    return mix(out)


def inside(bounds: np.ndarray, k: int) -> np.ndarray:
    """For each word, whether the k words from it on lie in its row; as long as `window_hashes`."""
    total = int(bounds[-1])
    n = max(0, total - k + 1)
    out = np.ones(n, dtype=bool)
    for b in range(1, k):
        at = bounds[1:-1] - b
        at = at[(at >= 0) & (at < n)]
        out[at] = False
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, k: int, is_word: np.ndarray, seed: int) -> list[np.ndarray]:
    """For each row its distinct shingles of k words, sorted; all words as one if there are fewer."""
    h, _, _, bounds = words(data, offsets, is_word, seed)
    win = window_hashes(h, k)
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= k:
            out.append(np.unique(win[a : b - k + 1]))
        elif b > a:
            out.append(window_hashes(h[a:b], b - a))
        else:
            out.append(win[:0])
    return out
