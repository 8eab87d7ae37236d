"""Whole texts to ids with a tokenizer file; ids are exactly those of the library's encode.

A tokenizer that splits text into words first gives each word the same ids wherever it stands. Encoder finds the words of Latin-1
texts with array operations and remembers the ids of those that it met in a table of fixed size; the library encodes
each other word, and every text for which this isn't safe.
"""

from __future__ import annotations

import ctypes
import gc
import json
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from tokenizers import Tokenizer

from relspan.llm.bytewords import slices

#: Words whose ids a worker remembers, and ids that these may have together: 30 MB at most, whatever the input.
SLOTS = 1 << 19
POOL = 8 * SLOTS
#: Characters that are taken together (or one longer text).
SLICE = 200_000
LONGEST = 16  # bytes of a word that is remembered

#: The only normalizer and pre-tokenizer whose words this module finds itself.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
WORD_END = "</w>"

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _kinds() -> np.ndarray:
    """What the pattern takes each Latin-1 character for, after lower-casing."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[[*range(0x09, 0x0E), 0x20]] = _SPACE
    kind[[*range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER
    kind[[*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
    return kind


_KIND = _kinds()
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A or (0xC0 <= c <= 0xDE and c != 0xD7) else c for c in range(256))
#: Characters that other rules than the pattern's own treat: null, separators, and white space beyond ASCII.
_UNSAFE = {0x00, *range(0x1C, 0x20), 0x85, 0xA0}
_SAFE = bytes(c for c in range(256) if c not in _UNSAFE)
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of the first n bytes


def _give_back() -> None:
    """Return to the system what building something has left free; the C library keeps it otherwise."""
    gc.collect()
    if sys.platform.startswith("linux"):
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # a C library without it
            pass


class Encoder:
    """encode(texts) with add_special_tokens=False."""

    def __init__(self, tokenizer_json: str) -> None:
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values(), default=0) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        made = json.loads(tokenizer_json)
        model = made.get("model") or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback")) and model.get("end_of_word_suffix") == WORD_END
        special = all(t["content"].startswith("<|") for t in made.get("added_tokens") or [])
        self.by_word = plain and special and made.get("normalizer") == NORMALIZER and made.get("pre_tokenizer") == PRE_TOKENIZER
        del vocabulary, made, model
        self._forget()
        _give_back()

    def _forget(self) -> None:
        self.keys = np.zeros((SLOTS, 2), np.uint64)
        self.begin, self.n = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool = np.empty(0, np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _raw(self, text: str) -> bytes | None:
        """The text in lower case, a byte a character; None if it must go through the library whole."""
        if not self.by_word or "<|" in text:
            return None
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if raw.translate(None, _SAFE) else raw.translate(_LOWER)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of words, from the library."""
        all_ids, all_sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for cut in range(0, len(words), 2000):
            some = words[cut : cut + 2000]
            ids = self._whole(" ".join(some))
            size = np.diff(np.flatnonzero(np.append(True, self.ends[ids])))
            if len(size) != len(some):  # some word has no end of its own
                each = [self._whole(x) for x in some]
                ids, size = np.concatenate(each), np.array([len(x) for x in each])
            all_ids.append(ids)
            all_sizes.append(size)
        return np.concatenate(all_ids), np.concatenate(all_sizes)

    def _compact(self) -> None:
        """Drop ids of words that others have displaced; all if that isn't enough."""
        live = np.flatnonzero(self.n)
        n, begin = self.n[live].astype(np.int64), self.begin[live].astype(np.int64)
        before = np.cumsum(n) - n
        if n.sum() > POOL // 2:
            self._forget()
            return
        self.pool = self.pool[np.arange(n.sum()) + np.repeat(begin - before, n)]
        self.begin[live] = before

    def _words(self, joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends) of the words of joined texts: what the pattern matches."""
        data = np.frombuffer(joined, np.uint8)
        kind = _KIND[data]
        start = np.zeros(len(data), bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == _NUMBER
        quote = np.flatnonzero(data == ord("'"))
        quote = quote[kind[quote - 1] != _OTHER]  # else it is inside a run of other characters
        if len(quote):
            a, b = data[quote + 1], data[quote + 2]
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
            quote, size = quote[one | two], np.where(two, 3, 2)[one | two]
            start[quote + 1] = False
            start[quote + size] |= kind[quote + size] == _LETTER
        edge = np.flatnonzero(start | (kind == _SPACE))
        k = np.flatnonzero(kind[edge] != _SPACE)
        return data, edge[k], edge[k + 1]

    def _encoded(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of each text, places in pool and numbers of ids of each word, pool)."""
        joined = b" ".join([b"", *raws, b" " * LONGEST])
        data, at, end = self._words(joined)
        first = np.cumsum([1, *(len(x) + 1 for x in raws)])
        size = end - at
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        lo, hi = eight[at] & _FIRST[np.minimum(size, 8)], eight[at + 8] & _FIRST[np.clip(size - 8, 0, 8)]
        h = (lo * np.uint64(0x9E3779B97F4A7C15)) ^ (hi * np.uint64(0xC2B2AE3D27D4EB4F))
        slot = ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % SLOTS
        keys = self.keys[slot]
        known = (keys[:, 0] == lo) & (keys[:, 1] == hi) & (size <= LONGEST)
        begin, n, pool = self.begin[slot].astype(np.int64), self.n[slot].astype(np.int64), self.pool
        new = np.flatnonzero(~known)
        if len(new):
            number: dict[bytes, int] = {}
            which = np.fromiter((number.setdefault(joined[a:b], len(number)) for a, b in zip(at[new].tolist(), end[new].tolist())), np.int64, len(new))
            ids, sizes = self._learn([x.decode("latin-1") for x in number])
            begin[new], n[new] = (len(pool) + np.cumsum(sizes) - sizes)[which], sizes[which]
            self.pool = pool = np.concatenate([pool, ids])
            short = new[size[new] <= LONGEST]
            taken, one = np.unique(slot[short], return_index=True)  # of those that meet in a slot one stays
            short = short[one]
            self.keys[taken, 0], self.keys[taken, 1], self.begin[taken], self.n[taken] = lo[short], hi[short], begin[short], n[short]
            if len(pool) > POOL:
                self._compact()
        doc = np.searchsorted(first, at, "right") - 1
        return np.bincount(doc, n, len(raws)).astype(np.int64), begin, n, pool

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for part in slices(texts, SLICE):
            raws = [self._raw(x) for x in part]
            count, begin, n, pool = self._encoded([r for r in raws if r is not None])
            before = np.cumsum(n) - n
            ids = pool[np.arange(n.sum()) + np.repeat(begin - before, n)]
            ends = iter(np.cumsum(count))
            at = 0
            for x, r in zip(part, raws):
                if r is None:
                    yield self._whole(x)
                else:
                    to = next(ends)
                    yield ids[at:to]
                    at = to

    def count(self, texts: list[str | None]) -> Iterator[int]:
        """Number of ids of each text."""
        for part in slices(texts, SLICE):
            raws = [self._raw(x) for x in part]
            count = iter(self._encoded([r for r in raws if r is not None])[0].tolist())
            for x, r in zip(part, raws):
                yield len(self._whole(x)) if r is None else next(count)


_ENCODERS: dict[int, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """This worker's encoder; what it remembers, which is bounded, serves the next tasks too."""
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer_json)
    return _ENCODERS[key]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI that every executor can reach: file, hdfs, s3 (or s3a), gs."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_file(uri: str, chunks: Iterator[bytes]) -> int:
    """Write under a name of this attempt, then move into place: a task that runs again replaces its own file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with fs.open_output_stream(own) as f:
        for c in chunks:
            n += f.write(c) or 0
    fs.move(own, path)
    return n


def open_file(uri: str) -> pa.NativeFile:
    fs, path = filesystem(uri)
    return fs.open_input_stream(path, compression=None)


def open_places(uri: str) -> pa.NativeFile:
    """A file of which any place can be read."""
    fs, path = filesystem(uri)
    return fs.open_input_file(path)
