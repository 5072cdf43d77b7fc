"""The Merkle manifest against trees built in plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from polyphon.llm import manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def steps(levels, i):
    for nodes in levels[:-1]:
        a = i // 3 * 3
        yield "".join(nodes[a:i]), "".join(nodes[i + 1 : a + 3])
        i //= 3


def proofs(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0], leaf_of(r)))
    for own in by.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: tree([n for _, n in own]) for s, own in by.items()}
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = tree([trees[s][-1][0] for s in names])
    return Counter(
        (i, s, n, tuple([*steps(trees[s], k), *steps(top, names.index(s))]), trees[s][-1][0], top[-1][0]) for s in names for k, (i, n) in enumerate(by[s])
    )


def check(docs, digits):
    got = manifest.build_manifest(docs, digits=digits).withColumn("fold", manifest.folded(F.col("leaf"), F.col("path"))).collect()
    rows = [tuple(r) for r in docs.select(*FIELDS).collect()]
    assert Counter((r.id, r.group, r.leaf, tuple(map(tuple, r.path)), r.subroot, r.root) for r in got) == proofs(rows)
    assert all(r.fold == r.root and r.told == r.leaf for r in got)


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_sources_of_any_size(spark, digits):
    """Groups of 1 to 28 leaves, a null one among them, over up to four tiers."""
    sizes = {None: 2, "": 1, "a": 3, "é": 4, "B": 9, "b": 10, "zz": 28}
    rows = [(1000 - 7 * i, s, None if i % 3 else "x", i, f"text\n{i}") for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    check(docs, digits)


def test_doubtful_rows(doubtful, empty):
    check(doubtful, 6)
    assert manifest.build_manifest(empty).count() == 0


def test_tampering_is_seen(spark):
    docs = spark.createDataFrame([(1, "s", "en", 3, "a\nb"), (2, "s", "en", 2, "ab")], "doc_id long, source string, lang string, n_chars long, text string")
    told = manifest.record_digest([F.col(c) for c in FIELDS[:4]] + [F.translate("text", "\n", "")])
    got = manifest.build_manifest(docs, told=told).select("id", (manifest.folded(F.col("told"), F.col("path")) == F.col("root")).alias("ok"))
    assert {r.id: r.ok for r in got.collect()} == {1: False, 2: True}
    assert leaf_of((None, "", "é", None, "x")) == docs.select(
        manifest.record_digest([F.lit(None), F.lit(""), F.lit("é"), F.lit(None), F.lit("x")])
    ).first()[0]
