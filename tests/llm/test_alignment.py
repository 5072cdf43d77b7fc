"""Cross-tokenizer alignment against token lists, byte ranges and counts in plain Python."""

import json
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from polyphon.llm import alignment
from polyphon.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER, QUERIES
from polyphon.llm.tokens import byte_letters

A = Tokenizer.from_file(BYTE_TOKENIZER)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECE_TOKENIZER)
SF = "/root/testdata/sf0.001"
BYTE_OF = {c: b for b, c in byte_letters().items()}
ENTRY = {i: bytes(BYTE_OF[c] for c in t) for t, i in json.load(open(BYTE_TOKENIZER, encoding="utf-8"))["model"]["vocab"].items()}


def tokens(text):
    """Ids and bytes of both sides; None where there are none."""
    if not text:
        return None
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    bytes_a = [ENTRY.get(i, b"<|endoftext|>") for i in a]
    pieces = [B.id_to_piece(i) for i in b]
    bytes_b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    return a, b, bytes_a, bytes_b


def ranges(parts):
    at = 0
    for p in parts:
        yield at, at + len(p)
        at += len(p)


def expected(rows):
    linked, docs = Counter(), []
    for i, text in rows:
        found = tokens(text)
        if found is None:
            docs.append((i, 0, 0, 0, [], ""))
            continue
        a, b, bytes_a, bytes_b = found
        ra, rb = list(ranges(bytes_a)), list(ranges(bytes_b))
        links = [(a[x], b[y]) for x, (s, e) in enumerate(ra) for y, (s2, e2) in enumerate(rb) if s < e2 and s2 < e]
        ends = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, at = [], 0
        for end in ends:
            own = [",".join(str(t) for t, (s, e) in zip(ids, r) if at <= s and e <= end) for ids, r in ((a, ra), (b, rb))]
            groups.append("|".join(own))
            at = end
        linked.update(links)
        docs.append((i, len(a), len(b), len(groups), links, ";".join(groups)))
    highest = defaultdict(int)
    for (_, y), n in linked.items():
        highest[y] = max(highest[y], n)
    return Counter(
        (i, n_a, n_b, n_g, len(links), sum(linked[p] == highest[p[1]] for p in links), sum(linked[p] for p in links),
         sha256(g.encode()).hexdigest() if g else "", g)
        for i, n_a, n_b, n_g, links, g in docs
    )


def check(docs):
    got = alignment.align(docs, BYTE_TOKENIZER, PIECE_TOKENIZER, with_groups=True).collect()
    assert Counter(map(tuple, got)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def short(docs):
    """The brute force compares all tokens of a text with each other."""
    return docs.where("length(text) < 4000 OR text IS NULL")


def test_against_brute_force(monkeypatch, spark, sf_docs):
    check(short(sf_docs).repartition(3))


def test_doubtful_rows(spark, doubtful, empty, documents):
    odd = ["<|endoftext|> <s> </s> <unk>", "  two  spaces ", "tab\there\r\n\n", "a b c　d", "x​ y", "\x00 z", "naïve Ünïcode 漢字", "▁under▁", "ﬁ ½"]
    check(short(doubtful).unionByName(documents(list(enumerate(odd, 100)))))
    assert alignment.align(empty, BYTE_TOKENIZER, PIECE_TOKENIZER).count() == 0


def test_the_query_is_the_operator(spark, sf_docs):
    rows = QUERIES["op12_alignment"](spark, SF).collect()
    assert len(rows) == sf_docs.count() and sum(r.n_links for r in rows) > 0
    assert all(0 < r.n_groups <= min(r.n_a, r.n_b) and r.n_best <= r.n_links <= r.count_sum for r in rows if r.n_a)


def test_blocks_share_counts(monkeypatch, sf_docs):
    """Many small blocks give the same counts as one."""
    few = sf_docs.where("doc_id < 60")
    one = Counter(map(tuple, alignment.align(few.coalesce(1), BYTE_TOKENIZER, PIECE_TOKENIZER).collect()))
    assert Counter(map(tuple, alignment.align(few.repartition(17), BYTE_TOKENIZER, PIECE_TOKENIZER).collect())) == one


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.booleans(), max_size=150), st.lists(st.booleans(), max_size=150)), max_size=4))
def test_gallop_and_overlaps(texts):
    """Ends from random cuts of texts of one length on both sides; each text is searched on its own."""
    sides, before, base = ([], []), ([0], [0]), 0
    expected_links, expected_common = [], []
    for cuts in texts:
        size = max(map(len, cuts)) + 1
        own = [[base + i + 1 for i, c in enumerate(x) if c and i + 1 < size] + [base + size] for x in cuts]
        at = [len(sides[0]), len(sides[1])]
        spans = [list(zip([base, *e[:-1]], e)) for e in own]
        expected_links += [(at[0] + i, at[1] + j) for i, (s, e) in enumerate(spans[0]) for j, (s2, e2) in enumerate(spans[1]) if s < e2 and s2 < e]
        expected_common += [(at[0] + i, at[1] + own[1].index(e)) for i, e in enumerate(own[0]) if e in own[1]]
        for k in (0, 1):
            sides[k].extend(own[k])
            before[k].append(len(sides[k]))
        base += size
    arrays = [np.array(x, np.int64) for x in (sides[0], before[0], sides[1], before[1])]
    i, j, ci, cj = alignment.overlaps(*arrays)
    assert list(zip(i.tolist(), j.tolist())) == expected_links
    assert list(zip(ci.tolist(), cj.tolist())) == expected_common


def test_ids_are_those_of_the_library(doubtful):
    a, b = alignment.tokenizers_of(BYTE_TOKENIZER, PIECE_TOKENIZER)
    texts = [" " + (r.text or "") for r in doubtful.collect()] + [" it's  A 1b é c’d  e <|endoftext|> x\n y. z ,a"]
    for _ in range(2):
        ids, before = a.encode(pa.array(texts))
        got = [ids[x:y].tolist() for x, y in zip(before[:-1], before[1:])]
        assert got == [A.encode(t, add_special_tokens=False).ids for t in texts]
        ids, before = b.encode(pa.array(texts))
        assert [ids[x:y].tolist() for x, y in zip(before[:-1], before[1:])] == [B.encode(t[1:]) if t[1:] else [] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é's'tlm.,-1 \n\t 漢", max_size=40))
def test_pieces_never_change_ids(text):
    a, b = alignment.tokenizers_of(BYTE_TOKENIZER, PIECE_TOKENIZER)
    assert a.encode(pa.array([" " + text]))[0].tolist() == A.encode(" " + text, add_special_tokens=False).ids
    assert b.by_word and (not text or b.encode(pa.array([" " + text]))[0].tolist() == B.encode(text))
