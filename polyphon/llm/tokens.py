"""Token ids of whole texts through the tokenizers library, one call per distinct word.

The word-level BPE vocabulary never merges across white space or from a letter
to a mark, so the ids of a text are the ids of its pieces, one after the other.
A worker keeps the ids of the pieces it has seen, by the hash of their
lower-case bytes; only pieces it has not seen go to the library. The store is
bounded in bytes, emptied when full and at the end of a task, which costs time
and changes no result.

Pieces of plain Latin letters (already composed) go to the library's model
behind a splitter at white space, since its normaliser and its own splitter
would hand them over as they are; there the end-of-word tokens say where each
piece's ids end. All others take the library's full path. Texts are cut at the
six ASCII white-space characters and between a Latin letter and one of a few
ASCII marks that occur in no special token; any other border stays inside a
piece and is left to the library.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from polyphon.llm.base import give_back_memory, text_slices
from polyphon.llm.wordhash import SPACE, byte_set, column_bytes, span_hashes, word_spans

#: Bound of a worker's store; its arrays take at most twice that while one is grown.
STORE_BYTES = 24 << 20
RECENT_WORDS = 50_000
CHUNK = 2000
END_ID = 2

_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A))
_MARK = np.isin(np.arange(256), list(b".,!?;:%#&()*+-/=\"_"))
#: Second bytes of the two-byte letters of the Latin-1 block, which begin with 0xC3.
LATIN = byte_set((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))


def _cuts(data: np.ndarray) -> np.ndarray:
    """True at a mark behind a Latin letter, and at a Latin letter behind a mark."""
    n = len(data)
    mark, ends = _MARK[data], _LETTER[data]
    begins = ends.copy()
    two = (data[:-1] == 0xC3) & LATIN[data[1:]] if n > 1 else np.zeros(0, bool)
    ends[1:] |= two
    begins[:-1] |= two
    cuts = np.zeros(n, bool)
    cuts[1:] = (ends[:-1] & mark[1:]) | (mark[:-1] & begins[1:])
    return cuts


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Runs:
    """Id runs by hash: two sorted key tables, a small one that new keys go to, over one array of ids."""

    def __init__(self):
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.tables = [empty, empty]
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the run of each key; length -1 where there is none."""
        start, length = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for own, starts, lengths in self.tables:
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[at] == keys
                start[hit], length[hit] = starts[at[hit]], lengths[at[hit]]
        return start, length

    def add(self, keys: np.ndarray, runs: list[bytes]) -> None:
        lengths = np.array([len(r) for r in runs], np.int64) // 4
        new = np.frombuffer(b"".join(runs), "<u4")
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(new)), np.uint32)])
        self.ids[self.used : self.used + len(new)] = new
        self._merge(1, (keys, self.used + np.cumsum(lengths) - lengths, lengths))
        self.used += len(new)
        if len(self.tables[1][0]) > RECENT_WORDS:
            self._merge(0, self.tables[1])
            self.tables[1] = tuple(x[:0] for x in self.tables[1])

    def _merge(self, k: int, more: tuple) -> None:
        both = [np.concatenate(x) for x in zip(self.tables[k], more)]
        order = np.argsort(both[0], kind="stable")
        self.tables[k] = tuple(x[order] for x in both)

    @property
    def nbytes(self) -> int:
        return self.ids.nbytes + sum(x.nbytes for t in self.tables for x in t)


class PieceIds:
    """Ids of whole texts from the ids of their pieces, kept by hash; a subclass says what pieces are."""

    def __init__(self):
        self.runs = _Runs()

    def pieces(self, data: np.ndarray, offsets: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, the number of pieces before each text (one more than texts), and hashes."""
        raise NotImplementedError

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit numbers."""
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one run, and the number of ids before each text (one entry more than texts)."""
        data, offsets = column_bytes(texts)
        raw = data.tobytes()
        starts, ends, before, hashes = self.pieces(data, offsets, raw)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.runs.nbytes > STORE_BYTES:
            self.runs = _Runs()
        run, length = self.runs.find(keys)
        missing = np.flatnonzero(length < 0)
        if len(missing):
            at = first[missing]
            self.runs.add(keys[missing], self.encode_pieces([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]))
            run[missing], length[missing] = self.runs.find(keys[missing])
        run, length = run[inverse], length[inverse]
        done = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=done[1:])
        ids = self.runs.ids[np.repeat(run - done[:-1], length) + np.arange(done[-1])]
        return ids, done[before]


class WordIds(PieceIds):
    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The same model behind white space alone, for pieces that are ready for it.
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(spec))
        suffix, vocabulary = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.letters = [(chr(b), c) for b, c in byte_letters().items() if ord(c) > 255 and b > 127]

    def full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, words: list[str]) -> dict[str, bytes]:
        found = {}
        for first in range(0, len(words), CHUNK):
            some = words[first : first + CHUNK]
            joined = " ".join(some).lower().encode().decode("latin-1")
            if not joined.isascii():
                for byte, letter in self.letters:
                    joined = joined.replace(byte, letter)
            ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            raw, start = ids.tobytes(), 0
            for word, end in zip(some, (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                found[word] = raw[start:end]
                start = end
        return found

    def pieces(self, data: np.ndarray, offsets: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, before = word_spans(data, offsets, ~SPACE, _cuts(data))
        # Special tokens are told from other strings by case; there letters are not folded.
        hashes = span_hashes(data, starts, ends, None) if b"<|" in raw else span_hashes(data, starts, ends)
        return starts, ends, before, hashes

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        plain = self._plain([w for w in pieces if _PLAIN.fullmatch(w)])
        return [plain[w] if w in plain else self.full(w) for w in pieces]


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per Python worker; the tokenizers stay over its tasks, the store does not."""
    return WordIds(path)


def text_ids(batches: Iterator[pa.RecordBatch], path: str, end_id: int = END_ID) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batches of a task in slices, with the ids of their ``text``; the store is freed with the task."""
    try:
        for batch in text_slices(batches, "text"):
            yield batch, encode_column(batch.column("text"), path, end_id)
    finally:
        word_ids(path).runs = _Runs()
        give_back_memory()


def encode_column(texts: pa.Array, path: str, end_id: int = END_ID) -> list[np.ndarray]:
    """Ids of each text with ``end_id`` behind them; null texts are empty."""
    ids, before = word_ids(path).encode(texts)
    ids = np.insert(ids, before[1:], end_id)
    before = before + np.arange(len(before))
    return [ids[a:b] for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
