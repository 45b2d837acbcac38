"""CRC-32 of all word n-grams of texts from one scan with running CRCs.

A CRC without its fixed start and end values is linear over GF(2): the register after A and then B
is the register after A, shifted over the bytes of B, plus that of B alone. So B's own register is
the difference of two running ones, the earlier shifted by the length of B, and every n-gram of a
text costs two look-ups and a shift, whatever its length. Shifts by powers of two are 32 x 32
matrices over GF(2), kept as four tables of 256 entries; a shift by any length takes one for each
bit of the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The reversed polynomial of CRC-32, and its start and end value.
POLYNOMIAL, FULL = np.uint32(0xEDB88320), np.uint32(0xFFFFFFFF)
#: Bytes between two points where the scan is joined up; words handled at a time.
WIDTH, WORDS = 256, 1 << 19


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ POLYNOMIAL, table >> 1).astype(np.uint32)
    return table


BYTE = _byte_table()


def _lanes(columns: np.ndarray) -> np.ndarray:
    """The matrix with these columns as tables: row k has the images of all values of byte k."""
    out = np.zeros((4, 256), np.uint32)
    values = np.arange(256, dtype=np.uint32)
    for bit in range(32):
        out[bit // 8] ^= np.where(values >> np.uint32(bit % 8) & 1, columns[bit], 0).astype(np.uint32)
    return out


def _apply(lanes: np.ndarray, v: np.ndarray) -> np.ndarray:
    return lanes[0][v & 255] ^ lanes[1][v >> 8 & 255] ^ lanes[2][v >> 16 & 255] ^ lanes[3][v >> 24]


def _shifts() -> list[np.ndarray]:
    """Tables of the shifts over 1, 2, 4, ... bytes."""
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = BYTE[columns & 255] ^ (columns >> 8)
    out = []
    for _ in range(40):
        out.append(_lanes(columns))
        columns = _apply(out[-1], columns)
    return out


SHIFTS = _shifts()


def shifted(registers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each register after that many zero bytes."""
    out = registers.copy()
    for bit in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero(lengths >> bit & 1)
        out[at] = _apply(SHIFTS[bit], out[at])
    return out


def running(data: np.ndarray) -> np.ndarray:
    """Register, started at 0, after each number of bytes from 0 to all.

    Stretches of WIDTH bytes are scanned side by side, then each takes what stands before it,
    found by doubling.
    """
    n = len(data)
    rows = max(1, -(-n // WIDTH))
    columns = np.zeros(rows * WIDTH, np.uint8)
    columns[:n] = data
    columns = np.ascontiguousarray(columns.reshape(rows, WIDTH).T)
    own = np.empty((WIDTH, rows), np.uint32)
    state = np.zeros(rows, np.uint32)
    for j in range(WIDTH):
        state = BYTE[(state ^ columns[j]) & 255] ^ (state >> 8)
        own[j] = state
    carried = state.copy()  # after each stretch, with all before it
    step, bit = 1, WIDTH.bit_length() - 1
    while step < rows:
        carried[step:] ^= _apply(SHIFTS[bit], carried[:-step])
        step, bit = step * 2, bit + 1
    before = np.concatenate([[np.uint32(0)], carried[:-1]])
    for j in range(WIDTH):
        before = BYTE[before & 255] ^ (before >> 8)
        own[j] ^= before
    return np.concatenate([[np.uint32(0)], own.T.reshape(-1)[:n]])


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, owners) of the words of all texts, with A-Z in lower case.

    A word is a run of ASCII letters and digits and of anything beyond ASCII. Nulls have none.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]].copy() if raw is not None and len(texts) else np.empty(0, np.uint8)
    offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
    data[(data >= 65) & (data <= 90)] += 32
    inside = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edges] = inside[edges]  # a word never goes on into the next text
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    owners = np.searchsorted(offsets, starts, side="right") - 1
    if texts.null_count and len(starts):
        known = ~np.asarray(texts.is_null())[owners]
        starts, ends, owners = starts[known], ends[known], owners[known]
    return data, starts, ends, owners


def gram_crcs(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owners, CRC-32s) of all runs of 1 to n words of each text, joined by one space.

    Words are laid end to end with one space behind each, in stretches that overlap by n - 1 words,
    and each stretch is scanned once.
    """
    data, starts, ends, owners = words_of(texts)
    for at in range(0, len(starts), WORDS):
        first, stop = max(0, at - n + 1), min(len(starts), at + WORDS)
        s, e, o = starts[first:stop], ends[first:stop], owners[first:stop]
        sizes = e - s + 1
        begins = np.cumsum(sizes) - sizes
        index = np.repeat(s - begins, sizes) + np.arange(sizes.sum())
        stops = begins + sizes - 1
        index[stops] = 0
        line = data[index]
        line[stops] = 32
        registers = running(line)
        for k in range(1, n + 1):
            head = np.arange(len(s) - k + 1)
            head = head[(o[head] == o[head + k - 1]) & (head + k - 1 >= at - first)]
            a, b = begins[head], stops[head + k - 1]
            yield o[head], registers[b] ^ shifted(registers[a] ^ FULL, b - a) ^ FULL
