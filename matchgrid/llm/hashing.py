"""Vectorised hashing of words and character n-grams with numpy.

Texts are laid end to end as code points. A prefix sum of code times power, modulo 2**64, gives
the polynomial hash of any stretch by one subtraction, so that no word is touched in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points hashed at a time. Longer texts are cut at white space, if there is any.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
_BASE, _UNBASE = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_ALNUM: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, CHUNK + (CHUNK >> 1))
        up, down = np.full(size, _BASE), np.full(size, _UNBASE)
        up[0] = down[0] = 1
        _POWERS[0] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finishes 64-bit hashes in place so that all their bits depend on all bits."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def is_space(codes: np.ndarray) -> np.ndarray:
    return (codes == 32) | ((codes >= 9) & (codes <= 13))


def is_alnum(codes: np.ndarray) -> np.ndarray:
    """Letters and digits; everything beyond the basic plane counts as one."""
    if not _ALNUM:
        _ALNUM.append(np.array([chr(i).isalnum() for i in range(0x10000)] + [True]))
    return _ALNUM[0][np.minimum(codes, 0x10000)]


def pieces(text: str, size: int = CHUNK) -> Iterator[str]:
    """The whole text in pieces, cut behind white space where there is some."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size)) + 1
        yield text[at : cut or at + size]
        at = cut or at + size
    yield text[at:]


def batches(texts: list[str], size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, starts, owners): texts laid end to end, each followed by a line feed.

    ``owners`` tells the index of the text that each piece belongs to.
    """
    held: list[str] = []
    owners: list[int] = []
    total = 0

    def flush():
        lengths = np.array([len(x) + 1 for x in held], np.int64)
        codes = np.frombuffer(("\n".join(held) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        return codes, np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.array(owners)

    for i, text in enumerate(texts):
        for piece in pieces(text, size):
            if held and total + len(piece) > size:
                yield flush()
                held, owners, total = [], [], 0
            held.append(piece)
            owners.append(i)
            total += len(piece) + 1
    if held:
        yield flush()


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.concatenate([edge, [len(inside)]])
    return edge[::2], edge[1::2]


def stretch_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end], whatever stands before."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes.astype(np.uint64) * up[: len(codes)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n codes from each position on."""
    c = codes.astype(np.uint64)
    m = max(0, len(c) - n + 1)
    h = np.full(m, np.uint64(n))
    for i in range(n):
        h *= _BASE
        h += c[i : i + m]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h
