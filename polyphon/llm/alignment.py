"""Alignment of two tokenizers over the same texts.

Both tokenizers cut a text's bytes (a space and the text) into tokens. Where a
token of A and a token of B end at the same byte, both cut there; between two
such places lies a group. A token of A and one of B are linked where their bytes
overlap.

The byte ends of the tokens are two rising lists. For each text the shorter one
drives a galloping search into the longer: from the place of the end before, the
step doubles until the next end is passed, and a binary search finishes inside
the last step. An end that is met exactly is a common one. The rank of an end in
the longer list is the number of the other tokens that end before it, so the
ranks of a token's two ends give the range of the tokens it overlaps. Texts are
searched in lockstep, in runs of ``RUN`` ends.

How often a pair of ids is linked is counted over the whole corpus. Texts are
worked on in blocks of some ``BLOCK_LINKS`` links; a block keeps a table of its
distinct pairs, and each text's links are stored as places in that table, so only
one row per block and pair is shuffled: to sum the counts by pair, and back to
its block, where the texts look them up. The counts that are highest for an id of
B are broadcast: at most one row per entry of B's vocabulary.

Ids of A come from pieces, cut where the byte-level splitter always begins anew:
before a lone space between a visible character and an ASCII letter, before an
ASCII mark behind a letter, and before an ASCII letter behind a lone line feed.
Ids of B come from pieces cut at such spaces alone, which no merge of its model
crosses (checked on its vocabulary). Each distinct piece goes to the library once;
a worker's stores of pieces are bounded in bytes.

Edge cases: null and empty texts, and texts that one of the tokenizers doesn't
give back byte by byte, have no tokens and zeros; special tokens inside texts are
plain text; null or repeated doc_ids keep their rows; a long text is one block;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from polyphon.llm.base import give_back_memory, text_slices
from polyphon.llm.tokens import LATIN, PieceIds, byte_letters
from polyphon.llm.wordhash import byte_set, column_bytes, span_hashes, word_spans
from polyphon.sources.workspace import materialize

RUN = 32
BLOCK_LINKS = 1_500_000
CHUNK = 5000

_LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A))
_VISIBLE = byte_set((0x21, 0x7E))
_MARK = byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_ALL = np.ones(256, bool)
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

STORED = (
    "block long, kind int, place long, total long, best boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, groups string, n_pairs long, pairs binary, counts binary"
)
PAIRS = "block long, place long, a long, b long, n long"
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
)


def _latin(data: np.ndarray) -> np.ndarray:
    """True at the last byte of a Latin-1 letter."""
    out = np.zeros(len(data), bool)
    out[1:] = (data[:-1] == 0xC3) & LATIN[data[1:]]
    return out


def _lone_spaces(data: np.ndarray) -> np.ndarray:
    """True at a space between a visible character and an ASCII letter."""
    out = np.zeros(len(data), bool)
    out[1:-1] = (data[1:-1] == 0x20) & (_VISIBLE[data] | _latin(data))[:-2] & _LETTER[data][2:]
    return out


class ByteTokens(PieceIds):
    """A byte-level BPE: ids of texts, and the bytes of every id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {letter: b for b, letter in byte_letters().items()}
        vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.table = ByteTable({i: bytes(byte_of[c] for c in t) for t, i in vocabulary.items()})

    def pieces(self, data, offsets, raw):
        letter, latin = _LETTER[data], _latin(data)
        cuts = _lone_spaces(data)
        cuts[1:] |= _MARK[data[1:]] & (letter | latin)[:-1]
        cuts[2:] |= letter[2:] & (data[1:-1] == 0x0A) & (_VISIBLE[data] | latin)[:-2]
        starts, ends, count = word_spans(data, offsets, _ALL, cuts)
        return starts, ends, count, span_hashes(data, starts, ends, None)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        out = []
        for first in range(0, len(pieces), CHUNK):
            found = self.tokenizer.encode_batch_fast(pieces[first : first + CHUNK], add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in found]
        return out


class PieceTokens(PieceIds):
    """A piece model that puts a space in front: ids of texts with that space, and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: No piece holds a space behind another character, so merges never cross such a place.
        self.by_word = not any("▁" in name.lstrip("▁") for name in names)

        def spelled(i: int) -> bytes:
            if self.model.is_byte(i):
                return bytes([int(_BYTE_PIECE.fullmatch(names[i])[1], 16)])
            return names[i].replace("▁", " ").encode()

        self.table = ByteTable({i: spelled(i) for i in range(len(names))})

    def pieces(self, data, offsets, raw):
        starts, ends, count = word_spans(data, offsets, _ALL, _lone_spaces(data) if self.by_word else None)
        return starts, ends, count, span_hashes(data, starts, ends, None)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in self.model.encode([p[1:] for p in pieces], num_threads=1)]


class ByteTable:
    """Byte strings by number, in one run."""

    def __init__(self, entries: dict[int, bytes]):
        self.size = max(entries) + 1
        own = [entries.get(i, b"") for i in range(self.size)]
        self.lengths = np.array([len(x) for x in own], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(own), np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after the other, and where each ends."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        places = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.data[places], ends


@functools.lru_cache(maxsize=1)
def tokenizers_of(path_a: str, path_b: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(path_a), PieceTokens(path_b)


def gallop(keys: np.ndarray, table: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each key the first place in ``table`` at or above it, in [low, high]; ``low`` is not past it."""
    lo, hi, step = low.copy(), low.copy(), 1
    active = np.flatnonzero(hi < high)
    while len(active):
        active = active[table[hi[active]] < keys[active]]
        lo[active] = hi[active] + 1
        hi[active] = np.minimum(hi[active] + step, high[active])
        active = active[hi[active] < high[active]]
        step *= 2
    active = np.flatnonzero(lo < hi)
    while len(active):
        mid = (lo[active] + hi[active]) // 2
        below = table[mid] < keys[active]
        lo[active] = np.where(below, mid + 1, lo[active])
        hi[active] = np.where(below, hi[active], mid)
        active = active[lo[active] < hi[active]]
    return lo


def ranks(ends: np.ndarray, before: np.ndarray, other: np.ndarray, other_before: np.ndarray) -> np.ndarray:
    """For each text's ends, the place of the first end in its other list that is not below."""
    out = np.zeros(len(ends), np.int64)
    sizes = np.diff(before)
    per_text = -(-sizes // RUN)
    text = np.repeat(np.arange(len(sizes)), per_text)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    at, stop = before[text] + RUN * number, np.minimum(before[text] + RUN * (number + 1), before[text + 1])
    low, high = other_before[text], other_before[text + 1]
    while len(at):
        low = gallop(ends[at], other, low, high)
        out[at] = low
        on = at + 1 < stop
        at, stop, low, high = at[on] + 1, stop[on], low[on], high[on]
    return out


def _range_list(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, …, first[1], …: ``counts`` numbers of each."""
    done = np.cumsum(counts)
    return np.repeat(first - (done - counts), counts) + np.arange(done[-1] if len(done) else 0)


def overlaps(short: np.ndarray, before: np.ndarray, long: np.ndarray, long_before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links (places in both lists), and the places of the common ends in both lists.

    Both lists hold rising byte ends, text after text; every text ends at the same byte in both.
    """
    rank = ranks(short, before, long, long_before)
    met = long[np.minimum(rank, len(long) - 1)] == short if len(long) else np.zeros(len(short), bool)
    first = np.zeros(len(short), np.int64)
    first[1:] = (rank + met)[:-1]
    opens = before[:-1][np.diff(before) > 0]
    first[opens] = long_before[:-1][np.diff(before) > 0]
    counts = rank - first + 1
    return np.repeat(np.arange(len(short)), counts), _range_list(first, counts), np.flatnonzero(met), rank[met]


def _sub(before: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of the chosen texts, and their number before each of these."""
    counts = np.diff(before)[chosen]
    out = np.zeros(len(chosen) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return _range_list(before[:-1][chosen], counts), out


class Aligned:
    """One slice of texts, aligned."""

    def __init__(self, texts: pa.Array, a: ByteTokens, b: PieceTokens):
        n = len(texts)
        texts = texts.fill_null("")
        spaced = pa.compute.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type))
        data, offsets = column_bytes(spaced)
        sides = []
        good = np.diff(offsets) > 1
        for tokens in (a, b):
            ids, before = tokens.encode(spaced)
            joined, ends = tokens.table.joined(ids)
            total = np.concatenate([[0], ends])[before]
            good &= np.diff(total) == np.diff(offsets)
            sides.append((ids, before, joined, ends, total))
        for ids, before, joined, ends, total in sides:
            some = np.flatnonzero(good)
            differs = joined[_range_list(total[some], np.diff(offsets)[some])] != data[_range_list(offsets[some], np.diff(offsets)[some])]
            owner = np.repeat(some, np.diff(offsets)[some])
            good[owner[differs]] = False
        some = np.flatnonzero(good)
        kept, self.before, byte_ends = [], [], []
        for ids, before, joined, ends, total in sides:
            places, own = _sub(before, some)
            kept.append(ids[places])
            byte_ends.append(ends[places] - np.repeat(total[some] - offsets[some], np.diff(own)))
            self.before.append(own)
        self.ids, self.texts, self.n = kept, some, n

        link_a, link_b, common_a, common_b = [], [], [], []
        sizes = [np.diff(x) for x in self.before]
        for shorter, chosen in ((0, np.flatnonzero(sizes[0] <= sizes[1])), (1, np.flatnonzero(sizes[0] > sizes[1]))):
            if not len(chosen):
                continue
            (p, pb), (q, qb) = _sub(self.before[shorter], chosen), _sub(self.before[1 - shorter], chosen)
            i, j, ci, cj = overlaps(byte_ends[shorter][p], pb, byte_ends[1 - shorter][q], qb)
            found = [(p[i], q[j]), (p[ci], q[cj])]
            (x, y), (cx, cy) = found if shorter == 0 else [f[::-1] for f in found]
            link_a.append(x), link_b.append(y), common_a.append(cx), common_b.append(cy)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.link_a, self.link_b = join(link_a), join(link_b)
        #: Last tokens of the groups, in order.
        self.common_a, self.common_b = np.sort(join(common_a)), np.sort(join(common_b))

    def per_text(self, before: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        out[self.texts] = np.diff(before)
        return out

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens of A, tokens of B, groups."""
        groups = np.searchsorted(self.common_a, self.before[0])
        return self.per_text(self.before[0]), self.per_text(self.before[1]), self.per_text(groups)

    def link_texts(self) -> np.ndarray:
        return self.texts[np.searchsorted(self.before[0], self.link_a, side="right") - 1] if len(self.link_a) else np.zeros(0, np.int64)

    def written(self, size_a: int, names: ByteTable) -> list[bytes | None]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``; None for a text without tokens."""
        out: list[bytes | None] = [None] * self.n
        na, nb = len(self.ids[0]), len(self.ids[1])
        group_a = np.searchsorted(self.common_a, np.arange(na))
        group_b = np.searchsorted(self.common_b, np.arange(nb))
        # A group's tokens of A stand before its tokens of B.
        last_a = np.concatenate([[-1], self.common_a])
        last_b = np.concatenate([[-1], self.common_b])
        symbols = np.zeros(na + nb, np.int64)
        place_a, place_b = np.arange(na) + last_b[group_a] + 1, np.arange(nb) + last_a[group_b + 1] + 1
        symbols[place_a], symbols[place_b] = self.ids[0], self.ids[1].astype(np.int64) + size_a
        data, ends = names.joined(symbols)
        data = data.copy()
        data[ends[place_a[self.common_a]] - 1] = ord("|")
        data[ends[place_b[self.common_b]] - 1] = ord(";")
        raw = memoryview(data.tobytes())
        done = np.concatenate([[0], ends])[self.before[0] + self.before[1]]
        for text, x, y in zip(self.texts.tolist(), done[:-1].tolist(), done[1:].tolist()):
            out[text] = raw[x : y - 1]
        return out


def _packed(values: np.ndarray) -> bytes:
    for kind in ("<u1", "<u2", "<u4"):
        if not len(values) or values.max() < 256 ** int(kind[2]):
            return values.astype(kind).tobytes()
    return values.astype("<u8").tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _aligned_blocks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, with_groups: bool) -> Iterator[pa.RecordBatch]:
    a, b = tokenizers_of(path_a, path_b)
    names = ByteTable({i: b"%d," % (i if i < a.table.size else i - a.table.size) for i in range(a.table.size + b.table.size)})
    part, number, held = TaskContext.get().partitionId() << 32, 0, 0
    rows: list[dict] = []
    codes: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in STORED.split(", ")])

    def flush() -> pa.RecordBatch:
        nonlocal rows, codes, owners, number, held
        pairs, inverse, counts = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        width = max(1, len(pairs))
        own, times = np.unique(np.concatenate(owners) * width + inverse, return_counts=True)
        cut = np.searchsorted(own, np.arange(len(rows) + 1) * width)
        for row, x, y in zip(rows, cut[:-1].tolist(), cut[1:].tolist()):
            row |= {"n_pairs": y - x, "pairs": _packed(own[x:y] % width), "counts": _packed(times[x:y]), "kind": 1}
        table = {"kind": 0, "n_pairs": len(pairs), "pairs": pairs.astype("<u8").tobytes(), "counts": _packed(counts)}
        out = [row | {"block": part + number} for row in ([table] if len(pairs) else []) + rows]
        rows, codes, owners, held = [], [], [], 0
        number += 1
        return pa.RecordBatch.from_pylist(out, schema)

    try:
        for batch in text_slices(batches, "text"):
            found = Aligned(batch.column("text"), a, b)
            n_a, n_b, n_groups = found.counts()
            texts = found.link_texts()
            n_links = np.bincount(texts, minlength=found.n)
            written = found.written(a.table.size, names)
            codes.append(found.ids[0][found.link_a].astype(np.uint64) * np.uint64(b.table.size) + found.ids[1][found.link_b])
            owners.append(texts + len(rows))
            for i, (doc, groups) in enumerate(zip(batch.column("doc_id").to_pylist(), written)):
                rows.append({
                    "doc_id": doc, "n_a": int(n_a[i]), "n_b": int(n_b[i]), "n_groups": int(n_groups[i]), "n_links": int(n_links[i]),
                    "groups_sha256": "" if groups is None else hashlib.sha256(groups).hexdigest(),
                    "groups": (bytes(groups).decode() if groups is not None else "") if with_groups else None,
                })
            held += len(texts)
            if held >= BLOCK_LINKS:
                yield flush()
        if rows:
            yield flush()
    finally:
        give_back_memory()


def _pair_rows(batches: Iterator[pa.RecordBatch], size_b: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, n, pairs, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "n_pairs", "pairs", "counts"))):
            codes = np.frombuffer(pairs, "<u8").astype(np.int64)
            columns = [np.full(n, block), np.arange(n), codes // size_b, codes % size_b, _unpacked(counts, n)]
            for first in range(0, n, 100_000):
                yield pa.record_batch([pa.array(c[first : first + 100_000], pa.int64()) for c in columns], names=["block", "place", "a", "b", "n"])


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block: first the counts of its pairs, by place, then its texts."""
    names = [f.split()[0] for f in ALIGNED.split(", ")]
    block, totals, bests = None, [], []
    total = best = np.zeros(0, np.int64)
    for batch in batches:
        blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
        for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)]):
            if x == y:
                continue
            part = batch.slice(x, y - x)
            if blocks[x] != block:
                block, totals, bests = blocks[x], [], []
            if kinds[x] == 0:
                totals.append(part.column("total").to_numpy())
                bests.append(part.column("best").to_numpy(zero_copy_only=False))
                continue
            if totals:
                # The texts of a block follow one another, so its lists are joined once.
                total, best = np.concatenate(totals), np.concatenate(bests)
                totals, bests = [], []
            sums, highest = [], []
            for n, pairs, counts in zip(*(part.column(c).to_pylist() for c in ("n_pairs", "pairs", "counts"))):
                at, times = _unpacked(pairs, n), _unpacked(counts, n)
                sums.append(int((times * total[at]).sum()))
                highest.append(int(times[best[at]].sum()) if n else 0)
            found = {"n_best": pa.array(highest, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
            yield pa.record_batch([found[c] if c in found else part.column(c) for c in names], names=names)


def align(
    docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``,
    and on request ``groups``, the alignment as text.

    ``n_best``: links whose pair is the most frequent of its B id; ``count_sum``:
    the corpus-wide counts of the links' pairs, added up.
    """
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = materialize(rows.mapInArrow(lambda batches: _aligned_blocks(batches, path_a, path_b, with_groups), STORED), "aligned_blocks")

    tables = blocks.where("kind = 0").select("block", "n_pairs", "pairs", "counts")
    pairs = tables.mapInArrow(lambda batches: _pair_rows(batches, size_b), PAIRS)
    # A pair has at most one row per block.
    summed = pairs.select("block", "place", "b", F.sum("n").over(Window.partitionBy("a", "b")).alias("total"))
    summed = materialize(summed, "aligned_pairs")
    # At most one row per id of B.
    highest = F.broadcast(summed.groupBy("b").agg(F.max("total").alias("highest")))
    counted = summed.join(highest, "b").select("block", "place", "total", (F.col("total") == F.col("highest")).alias("best"))
    counted = counted.withColumn("kind", F.lit(0))
    texts = blocks.where("kind = 1").drop("place", "total", "best")
    met = counted.unionByName(texts, allowMissingColumns=True)
    met = met.repartition("block").sortWithinPartitions("block", "kind", "place")
    found = met.mapInArrow(_looked_up, ALIGNED)
    return found if with_groups else found.drop("groups")
