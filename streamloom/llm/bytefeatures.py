"""Features of whole texts, computed over many texts at once from their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _M1)
_POWER = mixed(np.arange(1, 257, dtype=np.uint64) * _M3) | np.uint64(1)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first text, folded bytes, offsets) of runs of texts; nulls are empty. Folding lowers A-Z and the Latin-1 letters."""
    import pyarrow.compute as pc

    array = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    if not len(array):
        return
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(array):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        part = _LOWER[data[offsets[first] : offsets[last]]]
        if len(part):
            latin = np.zeros(len(part), bool)
            latin[1:] = (part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E) & (part[1:] != 0x97)
            part[latin] += 0x20
        yield first, part, offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(part: np.ndarray, offsets: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(hash, text number) of each word: a maximal run of digits, letters a-z and bytes over 127; and the hashes of its first bytes, for each length in `stems`."""
    inside = _IN_WORD[part]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    at = np.nonzero(inside)[0]
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in stems]
    starts = np.nonzero(first[at])[0]
    nth = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    terms = _BYTE[part[at]] * _POWER[nth & 255]
    short = [mixed(np.add.reduceat(np.where(nth < k, terms, np.uint64(0)), starts)) for k in stems]
    return mixed(np.add.reduceat(terms, starts)), np.searchsorted(offsets, at[starts], "right") - 1, short


def gram_values(part: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to `most` (at most 4): the n-byte value at each byte, and whether it lies in one text."""
    value = np.zeros(len(part), np.uint32)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(part))
    for n in range(1, most + 1):
        value[: len(part) - n + 1] |= part[n - 1 :].astype(np.uint32) << np.uint32(8 * (n - 1))
        yield value, left >= n
