"""Words of many texts at once, as 64-bit hashes.

A word's hash is the sum of a pseudo-random number for each of its bytes, which depends on the byte and
on its place in the word, mixed with the length. Running sums give the sums of all words of a block, and
a word that reaches over a block's end carries its sum along, so no array is larger than a block. Sums of
unrelated numbers have no structure that two different words could share, as polynomials of the bytes
modulo 2^64 have; two words collide by chance alone, 1 in 2^64 for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words as the contracts define them: all but the space and U+0009 to U+000D.
IN_WORD = np.ones(256, bool)
IN_WORD[[32, *range(9, 14)]] = False
#: Letters, digits and whatever is not ASCII: words without the punctuation that clings to them.
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
PLACES = 64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def byte_numbers(at: np.ndarray) -> np.ndarray:
    """The number of a byte (low eight bits) at its place in a word (all higher bits)."""
    return mixed(mixed(at.astype(U64) + U64(0x9E3779B97F4A7C15)) + U64(0xD1B54A32D192ED03))


NEAR = byte_numbers(np.arange(256 * PLACES))
END = mixed(np.array([1], U64))[0]


def word_hashes(raw: np.ndarray, breaks: np.ndarray, block: int = 1 << 20, inside: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the lower-cased words in bytes; no word reaches over a break (sorted)."""
    starts, sums, sizes = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    open_at, open_sum = -1, np.zeros(1, U64)  # a word that the last block did not end
    for at in range(0, len(raw), block):
        part = raw[at : at + block]
        n = len(part)
        word = inside[part]
        before = np.concatenate(([open_at >= 0], word[:-1]))
        after = np.concatenate((word[1:], [bool(at + n < len(raw) and inside[raw[at + n]])]))
        cuts = breaks[np.searchsorted(breaks, at) : np.searchsorted(breaks, at + n, side="right")] - at
        before[cuts[cuts < n]] = False
        after[cuts[cuts > 0] - 1] = False
        first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        begin = np.full(n, -(1 << 62), np.int64)
        begin[first] = first
        if open_at >= 0:
            begin[0] = open_at - at
            first = np.concatenate(([0], first))
        place = np.arange(n) - np.maximum.accumulate(begin)
        number = NEAR[(np.minimum(place, PLACES - 1) << 8 | LOWER[part]) * word]
        far = np.flatnonzero(word & (place >= PLACES))
        number[far] = byte_numbers(place[far] << 8 | LOWER[part[far]])
        run = np.concatenate((np.zeros(1, U64), np.cumsum(number, dtype=U64)))
        ends = np.concatenate((last, [n])) if len(first) > len(last) else last
        got, start = run[ends] - run[first], first + at
        if open_at >= 0:
            got[:1] += open_sum
            start[0] = open_at
        if len(first) > len(last):
            open_at, open_sum = int(start[-1]), got[-1:].copy()
            got, start = got[:-1], start[:-1]
        else:
            open_at = -1
        starts.append(start)
        sums.append(got)
        sizes.append(last + at - start)
    size = np.concatenate(sizes).astype(U64)
    return np.concatenate(starts), mixed(np.concatenate(sums) + size * U64(0xD6E8FEB86659FD93))


def text_words(texts: pa.Array, inside: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each text) of an array of bytes; a null text has none."""
    texts = pa.array([], pa.binary()) if not len(texts) else texts.cast(pa.binary())
    if not len(texts):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    starts, hashes = word_hashes(raw, bounds, inside=inside)
    return hashes, np.diff(np.searchsorted(starts, bounds))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end token after each text."""
    hashes, n = text_words(texts)
    return np.insert(hashes, np.cumsum(n), END), n + 1


def grouped(batches: Iterator[pa.RecordBatch], column: str, tokens: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about ``tokens`` tokens (six bytes each)."""
    for b in batches:
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(column)], np.int64) // 6 + 1
        group = np.cumsum(sizes) // tokens
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)] if len(sizes) else []
        for x, y in zip(cuts, cuts[1:], strict=False):
            yield b.slice(x, y - x)
