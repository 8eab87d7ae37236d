"""Words of many texts at once, as arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Texts are taken together up to so many characters, so memory follows this or the longest text.
SLICE_CHARS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_FOLDED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


class Words(NamedTuple):
    hash: np.ndarray  # uint64, a word's bytes
    start: np.ndarray  # byte offsets in data
    end: np.ndarray
    doc: np.ndarray  # number of the text in the slice
    data: np.ndarray  # uint8
    prefix: np.ndarray  # for span_hash


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Cut a list of texts where ``chars`` is passed; null becomes the empty text."""
    part: list[str] = []
    held = 0
    for x in texts:
        part.append(x or "")
        held += len(part[-1])
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def _powers(n: int) -> None:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        for name, base in (("_POWERS", _BASE), ("_INVERSE", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def span_hash(w: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], wherever it stands: a difference of prefix sums in powers of an odd base."""
    return mix((w.prefix[end] - w.prefix[start]) * _INVERSE[start] + (end - start).astype(np.uint64))


def words_of(texts: list[str], inside: np.ndarray, fold: bool = False) -> Words:
    """Runs of the bytes that ``inside`` (256 booleans) marks, in every text. Byte 0 separates texts. fold: hashes take A-Z as a-z; data stays."""
    raw = [x.encode("utf-8", "replace") for x in texts]
    data = np.frombuffer(b"\0" + b"\0".join(raw) + b"\0", np.uint8)
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))
    _powers(len(data) + 1)
    edge = np.diff(inside[data].astype(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(((_FOLDED[data] if fold else data).astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], out=prefix[1:])
    w = Words(np.empty(0, np.uint64), start, end, np.searchsorted(ends, start, "left"), data, prefix)
    return w._replace(hash=span_hash(w, start, end))


def byte_set(keep: str) -> np.ndarray:
    """256 booleans: the ASCII characters of keep, and all bytes beyond ASCII."""
    out = np.zeros(256, bool)
    out[[ord(c) for c in keep]] = True
    out[128:] = True
    return out


LETTERS_DIGITS = byte_set("abcdefghijklmnopqrstuvwxyz0123456789")
NON_SPACE = ~np.isin(np.arange(256), [0, 9, 10, 11, 12, 13, 32])
