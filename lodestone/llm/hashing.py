"""Vectorised hashing of words and word shingles over UTF-8 bytes.

A word is a run of bytes other than space and \\t to \\r; A-Z are folded to
lower case and nothing else. Word hashes are polynomials over a random byte
table modulo 2^64, read off one prefix sum for a whole block of texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text hashed at once; a longer text is cut at white space into pieces of about this size.
BLOCK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_P = 0x9E3779B97F4A7C15
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = pow(_P, -1, 2**64)
        steps = [np.full(size, p, np.uint64) for p in (_P, inverse)]
        for x in steps:
            x[0] = 1
        _powers[:] = [np.cumprod(x, dtype=np.uint64) for x in steps]
    return _powers


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one block."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at white space."""
    at = 0
    while len(text) - at > BLOCK_BYTES:
        cut = max(text.rfind(c, at, at + BLOCK_BYTES) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:  # one word longer than a block
            ends = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := text.find(c, at + BLOCK_BYTES)) >= 0]
            cut = min(ends, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: Iterable[bytes | None], fold: bool = True) -> Iterator[np.ndarray]:
    """For each text in turn the 64-bit hashes of its words; null and blank texts have none."""
    block: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        hashes, starts = _hash_block(b"\n".join(block))
        ends = np.cumsum([len(x) + 1 for x in block])
        yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))

    for text in texts:
        text = (text.lower() if fold else text) if text else b""
        if len(text) > BLOCK_BYTES:
            if block:
                yield from flush()
                block, size = [], 0
            yield np.concatenate([_hash_block(x)[0] for x in _pieces(text)])
            continue
        if size + len(text) > BLOCK_BYTES and block:
            yield from flush()
            block, size = [], 0
        block.append(text)
        size += len(text) + 1
    if block:
        yield from flush()


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k words in order; a shorter text is one run, a text without words none."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = out * _Q + words[j : n - width + 1 + j]
    return mix(out)


def fingerprint(members: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed longs."""
    if not len(members):
        return 0, 0
    spread = mix(members ^ np.uint64(0xA5A5A5A55A5A5A5A))
    return int(members.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(spread).astype(np.int64))
