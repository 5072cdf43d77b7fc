"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all test items form one automaton (separate items, shared states);
each state knows the length of its longest string. A training document is
streamed through it word by word, which tracks the length of the longest suffix
that occurs in some item. Where that length reaches ``window`` words, the last
``window`` words are a contaminated stretch; an item with fewer words has to be
met whole. Following suffix links from the state tells the items.

A word that occurs in no item sends the automaton back to its root, so runs of
words that all occur in items are found first by hash, and only runs as long as
the shortest window are streamed; they are streamed by the words themselves.

Items are split into groups of at most ``group_words`` words, one automaton
each; documents are streamed through every group. The table of items is read by
the driver group by group, so what is shipped with the tasks has that bound.

Edge cases: null or empty items have no window; null texts have no words and are
clean; equal items under several ids all count; null item ids are ignored in
lists of items but do contaminate; repeated rows are scored each; an empty table
of items leaves all documents clean; extra columns are ignored, or with
``with_row`` kept beside the row's own result, which needs no id; with ``cut`` too,
a text without hits stays as it is, null included.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from polyphon.llm.base import text_slices
from polyphon.llm.wordhash import byte_set, column_bytes, span_hashes, word_spans
from polyphon.sources.workspace import materialize

WINDOW = 13
GROUP_WORDS = 100_000
WORD = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

HITS = "doc_id long, row_key long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def item_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


class SuffixAutomaton:
    """Generalised suffix automaton over words; per state the windows that end there."""

    def __init__(self, items: list[tuple[str | None, list[str]]], window: int = WINDOW):
        self.words: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        #: Per state: (window length, items) for windows whose last word leads here.
        self.ends: list[dict[int, set[str]]] = [{}]
        kept = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        for _, sequence in kept:
            last = 0
            for w in sequence:
                last = self._extend(last, w)
        for name, sequence in kept:
            self._mark(name, sequence)
        self.shortest = min((min(len(s), window) for _, s in kept), default=0)
        # Windows that end at a state or at one of its suffixes; links are shorter, so go by length.
        for state in sorted(range(len(self.length)), key=self.length.__getitem__):
            if state and self.ends[self.link[state]]:
                if not self.ends[state]:
                    self.ends[state] = self.ends[self.link[state]]
                    continue
                merged = {n: set(x) for n, x in self.ends[self.link[state]].items()}
                for n, x in self.ends[state].items():
                    merged.setdefault(n, set()).update(x)
                self.ends[state] = merged

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.next.append(following)
        self.link.append(0)
        self.ends.append({})
        return len(self.length) - 1

    def _mark(self, name: str | None, sequence: list[int]) -> None:
        size = min(len(sequence), self.window)
        for state, matched, at in self.stream(sequence):
            if at + 1 >= size:
                # The state whose strings include exactly the last ``size`` words.
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                self.ends[state].setdefault(size, set()).update([name] if name is not None else [])

    def stream(self, sequence: list[int]) -> Iterator[tuple[int, int, int]]:
        """Per word: state, length of the longest suffix that occurs in an item, place."""
        state = matched = 0
        following, link, length = self.next, self.link, self.length
        for at, w in enumerate(sequence):
            to = following[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = following[state].get(w)
            if to is None:
                matched = 0
            else:
                state, matched = to, matched + 1
            yield state, matched, at

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, set[str]]]:
        """Start, end and items of every window occurrence in a run of known words."""
        sequence = [self.words.get(w, -1) for w in words]
        for state, matched, at in self.stream(sequence):
            if matched < self.shortest:
                continue
            # The longest known suffix has ``matched`` words; only windows within it occur here.
            for size, names in self.ends[state].items():
                if size <= matched:
                    yield at + 1 - size, at + 1, names


def _spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [tuple(x) for x in merged]


def _scan(rows: DataFrame, automaton: SuffixAutomaton, cut: bool = False) -> DataFrame:
    """Hits per row; a column ``row`` goes through with its text, which ``cut`` takes the hits out of."""
    kept = ["text", "row"] if "row" in rows.columns else []
    schema = StructType([*StructType.fromDDL(HITS), *(rows.schema[c] for c in kept)])
    vocabulary = list(automaton.words)
    data, offsets = column_bytes(pa.array(vocabulary, pa.string()))
    known = np.sort(span_hashes(data, offsets[:-1], offsets[1:])) if vocabulary else np.zeros(0, np.uint64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            data, offsets = column_bytes(batch.column("text"))
            starts, ends, before = word_spans(data, offsets, WORD)
            hashes = span_hashes(data, starts, ends)
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            if len(known) and len(hashes):
                inside = np.zeros(len(hashes) + 1, bool)
                inside[:-1] = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
                first = np.zeros(len(hashes) + 1, bool)
                first[before] = True
                begins = inside & ~np.concatenate([[False], inside[:-1]]) | inside & first
                stops = np.flatnonzero(inside[:-1] & (~inside[1:] | first[1:])) + 1
                begins = np.flatnonzero(begins[:-1])
                long = stops - begins >= automaton.shortest
                raw = data.tobytes()
                for a, b in zip(begins[long].tolist(), stops[long].tolist()):
                    words = [raw[s:e].decode().translate(_LOWER) for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                    found = list(automaton.matches(words))
                    if found:
                        doc = int(np.searchsorted(before, a, side="right")) - 1
                        at = a - int(before[doc])
                        spans.setdefault(doc, []).extend((at + s, at + e) for s, e, _ in found)
                        items.setdefault(doc, set()).update(*(names for _, _, names in found))
            n = batch.num_rows
            yield pa.record_batch(
                [
                    batch.column("doc_id"), batch.column("row_key"), pa.array(np.diff(before), pa.int64()),
                    pa.array(
                        [[{"start": a, "end": b} for a, b in _spans(spans.get(i, []))] for i in range(n)],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                    ),
                    pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.string())), *(batch.column(c) for c in kept),
                ],
                names=["doc_id", "row_key", "n_words", "spans", "items", *kept],
            )

    # One function for both steps: two in a row would run two Python workers a task.
    return rows.mapInArrow((lambda batches: _without_hits(scan(batches))) if cut else scan, schema)


def _without_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with ``text`` cut at each row's own ``spans``."""
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        if any(spans):
            texts = batch.column("text").to_pylist()
            texts = [without_spans(t, [(s["start"], s["end"]) for s in own]) for t, own in zip(texts, spans)]
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        yield batch


def _groups(benchmark: DataFrame, item_col: str, text_col: str, window: int, group_words: int) -> Iterator[SuffixAutomaton]:
    group, size = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        words = item_words(text)
        if group and size + len(words) > group_words:
            yield SuffixAutomaton(group, window)
            group, size = [], 0
        group.append((item, words))
        size += len(words)
    yield SuffixAutomaton(group, window)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_words: int = GROUP_WORDS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_row: bool = False, cut: bool = False,
) -> DataFrame:
    """Per document row: ``doc_id``, ``n_words``, ``spans`` (word places that are hit, merged), ``items``.

    ``with_row`` adds the row's ``text`` and its other columns as the struct ``row``;
    ``cut`` takes the words that are hit out of that text.
    """
    cut = cut and with_row
    spread = F.xxhash64(F.monotonically_increasing_id())
    # A struct of the other columns, so they may have any names.
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row")] if with_row else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), spread.alias("row_key"), F.col(text_col).cast("string").alias("text"), *row)
    automata = _groups(benchmark, item_col, item_text_col, window, group_words)
    found = _scan(rows, next(automata), cut)
    more = next(automata, None)
    if more is None:
        return found.drop("row_key")
    stored = materialize(rows, "keyed_texts")
    rows = stored.drop("row")
    found = materialize(_scan(rows, SuffixAutomaton([], window)), "hits")
    tables = [found]
    for automaton in _groups(benchmark, item_col, item_text_col, window, group_words):
        hits = _scan(rows, automaton).where(F.size("spans") > 0)
        tables.append(materialize(hits, "hits"))
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t)
    merged = union.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = merged.select("row_key", "doc_id", "n_words", _merged_spans("spans").alias("spans"), "items")
    if not with_row:
        return merged.drop("row_key")
    rows = merged.join(stored.select("row_key", "text", "row"), "row_key").drop("row_key")
    return rows.mapInArrow(lambda batches: _without_hits(text_slices(batches, "text")), rows.schema) if cut else rows


def _merged_spans(column: str):
    """Sorted spans with those that touch or overlap put together."""
    kind = "array<struct<start:bigint,end:bigint>>"
    return F.aggregate(
        column,
        F.array().cast(kind),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def with_verdict(found: DataFrame, coverage_parts: int = 20) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: hits cover at least one word in ``coverage_parts``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * coverage_parts >= F.col("n_words"))
    )


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans; what stands between two removed words goes too."""
    if not text or not spans:
        return text
    words = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join(out) + text[at:]


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
