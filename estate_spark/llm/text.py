"""Words of whole texts as 64-bit hashes, many texts at once, without a Python step per word.

All texts of a batch become one byte buffer. A word's hash is a polynomial over random 64-bit
codes of its bytes (wrapping arithmetic) taken from running sums, then finished by bit mixing.
Two different words share a hash with a chance of about 2^-64.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
_CODE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_POWER = np.uint64(0x9E3779B97F4A7C15)            # odd, so it has an inverse
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}

#: Bytes that part words: blanks (20, 09-0D), or all that is no ASCII letter or digit.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
NON_WORD = np.zeros(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    NON_WORD[_a:_b + 1] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, n.bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[int(base)] = have
    return have[:n]


def _slices(buffer: np.ndarray, part: np.ndarray, size: int = 1 << 20):
    """(a, b) covering the buffer, each b behind a parting byte; longer only inside one word."""
    a, n = 0, len(buffer)
    while a < n:
        b = min(a + size, n)
        while b < n and not part[buffer[b - 1]]:
            more = np.flatnonzero(part[buffer[b:b + size]])
            b = b + int(more[0]) + 1 if len(more) else min(b + size, n)
        yield a, b
        a = b


def words(texts: list[bytes], part: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start, end) of every word; start and end are byte offsets in the
    buffer that joins the texts, each followed by a newline. Pass lower-cased bytes if wanted.
    Works through the buffer in slices, so beyond the result it needs a fixed amount of memory."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
    found = []
    for a, b in _slices(buffer, part):
        here = buffer[a:b]
        inside = np.zeros(len(here) + 2, np.int8)
        inside[1:-1] = ~part[here]
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        running = np.zeros(len(here) + 1, np.uint64)
        np.cumsum(_CODE[here] * _powers(_POWER, len(here)), dtype=np.uint64, out=running[1:])
        h = (running[ends] - running[starts]) * _powers(_INVERSE, len(here) + 1)[starts]
        found.append((mix(h + (ends - starts).astype(np.uint64)), starts + a, ends + a))
    if not found:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    h, starts, ends = (np.concatenate(x) for x in zip(*found))
    border = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return h, np.searchsorted(border, starts, side="right"), starts, ends


def parts(batches, rows: int = 500):
    """Arrow batches in slices of few rows, so that only few texts are Python strings at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def batches_of(texts: list[bytes], limit: int = 2 << 20):
    """Slices (a, b) of the list with about ``limit`` bytes each, one text at least."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def word_parts(texts: list[bytes], prefixes: tuple[int, ...], part: np.ndarray = NON_WORD):
    """Per kind of part (whole words, then each prefix length in bytes): (hash, text number) of
    every word that has it. Slices keep the memory beyond the result fixed."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
    border = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    for a, b in _slices(buffer, part):
        here = buffer[a:b]
        inside = np.zeros(len(here) + 2, np.int8)
        inside[1:-1] = ~part[here]
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        running = np.zeros(len(here) + 1, np.uint64)
        np.cumsum(_CODE[here] * _powers(_POWER, len(here)), dtype=np.uint64, out=running[1:])
        inverse = _powers(_INVERSE, len(here) + 1)[starts]
        owner = np.searchsorted(border, starts + a, side="right")
        yield mix((running[ends] - running[starts]) * inverse + (ends - starts).astype(np.uint64)), owner
        for k in prefixes:
            m = starts + k <= ends
            yield mix((running[starts[m] + k] - running[starts[m]]) * inverse[m] + np.full(1, 1 << 40 | k, np.uint64)), owner[m]


def spans(buffer: np.ndarray, part: np.ndarray, border) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word of a buffer that ends with a parting byte; words are also
    parted in front of each byte where ``border(slice)`` is true. Works through slices."""
    found = []
    for a, b in _slices(buffer, part):
        here = buffer[a:b]
        word = ~part[here]
        cut = border(here)
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | cut[1:]
        last[:-1] &= ~word[1:] | cut[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        running = np.zeros(len(here) + 1, np.uint64)
        np.cumsum(_CODE[here] * _powers(_POWER, len(here)), dtype=np.uint64, out=running[1:])
        h = (running[ends] - running[starts]) * _powers(_INVERSE, len(here) + 1)[starts]
        found.append((mix(h + (ends - starts).astype(np.uint64)), starts + a, ends + a))
    if not found:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    return tuple(np.concatenate(x) for x in zip(*found))
