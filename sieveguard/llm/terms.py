"""Terms of whole texts as Arrow lists: byte classes are looked up for a batch at once.

A term is a maximal run of bytes of one class, A-Z lower-cased. UTF-8 bytes from 0x80 on belong
to every class, so a term is the same run of characters as the matching pattern finds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DIGITS = b"0123456789"
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


class ByteClass:
    """The bytes that belong to a term: some of ASCII, and all above."""

    def __init__(self, ascii_part: bytes) -> None:
        self.others = bytes(c for c in range(128) if c not in ascii_part)
        self.lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
        # Lower case with a space for every other byte; no term holds a space.
        self.spaced = bytes(32 if c in self.others else self.lower[c] for c in range(256))


WORDS, WORDS_AND_NUMBERS = ByteClass(LETTERS), ByteClass(LETTERS + DIGITS)


def term_lists(texts: pa.Array, kind: ByteClass) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and how many each text has. Null texts have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[
        texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or ends[-1] == ends[0]:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    raw = texts.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes()
    bounds = ends - ends[0]
    held = np.frombuffer(raw.translate(kind.spaced), np.uint8) != 32
    # A term starts after another byte or with its text, and stops likewise.
    opens, closes = held.copy(), held.copy()
    np.greater(held[1:], held[:-1], out=opens[1:])
    np.greater(held[:-1], held[1:], out=closes[:-1])
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(raw))]
    opens[inner] = held[inner]
    closes[inner - 1] = held[inner - 1]
    starts = np.flatnonzero(opens)
    offsets = np.append(0, np.cumsum(np.flatnonzero(closes) + 1 - starts)).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_string(), len(starts), [
        None, pa.py_buffer(offsets), pa.py_buffer(raw.translate(kind.lower, kind.others))])
    return flat, np.diff(np.searchsorted(starts, bounds))


def term_bytes(flat: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms' bytes, and where each starts and how long it is."""
    if not len(flat):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[:len(flat) + 1]
    return np.frombuffer(flat.buffers()[2], np.uint8), offsets[:-1], np.diff(offsets)


def term_hashes(flat: pa.Array) -> np.ndarray:
    """A number of 31 bits of each term, from its length and bytes at four places."""
    data, first, size = term_bytes(flat)
    mixed = size.astype(np.uint64) * np.uint64(0x165667B1)
    for place, factor in ((first, 0x9E3779B1), (first + size // 2, 0x85EBCA77),
                          (first + size - 1, 0xC2B2AE3D), (first + size // 3, 0x27D4EB2F)):
        mixed += data[place].astype(np.uint64) * np.uint64(factor)
    return (mixed * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(33)).astype(np.int64)


def joined_terms(texts: pa.Array, kind: ByteClass, blocks: np.ndarray) -> list[pa.Array]:
    """All terms of each text in order, each after a space, as one string; a text without terms
    is one space.

    ``blocks`` gives the number of blocks that a text's terms are dealt into by a hash; there is
    an array for every block, of all texts with so many blocks.
    """
    flat, sizes = term_lists(texts, kind)
    data, _, size = term_bytes(flat)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    many = blocks.max(initial=0) > 1
    block = term_hashes(flat) % blocks[owner] if many else np.zeros(len(size), np.int64)
    out = []
    for b in range(int(blocks.max(initial=0))):
        own, mine = np.flatnonzero(blocks > b), block == b
        count = np.bincount(owner[mine], minlength=len(sizes))
        length = np.bincount(owner[mine], size[mine] + 1, minlength=len(sizes)).astype(np.int64)
        ends = np.append(0, np.cumsum(np.maximum(length, 1)[own]))
        # Spaces stand before every term, and alone for a text without one.
        width = size[mine] + 1
        before = np.cumsum(width) - width + np.repeat(
            np.cumsum((count == 0) & (blocks > b)), count)
        letters = np.ones(int(ends[-1]), bool)
        letters[before] = False
        letters[ends[:-1][count[own] == 0]] = False
        held = np.full(len(letters), 32, np.uint8)
        held[letters] = data[np.repeat(mine, size)] if many else data
        out.append(pa.Array.from_buffers(pa.large_string(), len(own), [
            None, pa.py_buffer(ends), pa.py_buffer(held)]).cast(pa.string()))
    return out
