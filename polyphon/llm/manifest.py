"""A Merkle manifest of a dataset, rolled up as nested structs.

Leaves are the digests of records. Within a group (a source) they are ranked by
id, and the rank is written in digits of the tree's arity. One shuffle brings
the leaves of a block together: the ``BLOCK_DIGITS`` lowest digits vary inside a
block, the others name it. Then the digits are grouped away one after the other,
lowest first, each time nesting the children's structs in their parent's; all
these groupings reuse the one shuffle. A block is then one row, with its tree.

Blocks are the leaves of the next tier, until a group is one block; the groups'
roots are the leaves of the tree above them. Going down again, every tier's
blocks meet the siblings on their way up by grouping, not by a join, and a
transform over the nested tree hands every leaf its siblings, which an explode
turns into rows. A row never holds more than a block of 3^6 leaves, so a group
of any size is spread over its blocks.

A tree is as high as its leaves need: where a group is a single block, levels of
one child above the first real branching are skipped, so a lone leaf is its
group's root. Inside a larger level a run may be short, even one node long; it is
hashed like any other.

Edge cases: null fields are told from empty ones by the encoding; a null group is
a group of its own, the first; null ids rank first; repeated ids rank by their
digests, so equal rows are equal leaves whose proofs differ by place only, in
stored order; texts of any length are hashed whole; an empty table gives no
rows; columns that aren't named are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from polyphon.operators.prefix import row_index
from polyphon.sources.workspace import materialize

ARITY = 3
BLOCK_DIGITS = 6

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Above = Callable[[DataFrame], DataFrame]


def record_digest(fields: list[Column]) -> Column:
    """Lowercase hex sha256 of the fields: ``-`` for null, else length in bytes, ``:``, value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``rank``, from 0 in each group: rows are range-sorted, and places within ranges become ranks."""
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    return row_index(materialize(placed, "manifest_order"), "place", keys=keys, name="rank").drop("place")


def _digest(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def _blocks(items: DataFrame, keys: list[str], arity: int, digits: int) -> DataFrame:
    """One row per block: ``keys``, ``block``, ``tree`` and ``node``, the digest that stands for it one tier up.

    ``items`` has ``keys``, ``rank``, ``node`` and a struct ``own`` that stays with the leaf.
    """
    places = [f"digit_{i}" for i in range(digits)]
    cut = items.select(
        *keys, (F.floor(F.col("rank") / F.lit(arity**digits))).cast("long").alias("block"),
        *(F.expr(f"pmod(rank div {arity**i}, {arity})").cast("int").alias(p) for i, p in enumerate(places)),
        F.struct("node", F.col("node").alias("top"), "own").alias("tree"),
    )
    level = cut.repartition(*keys, "block")
    for i, place in enumerate(places):
        # The place is the first field, so sorting the structs puts the children in order.
        child = F.struct(F.col(place).alias("place"), F.col("tree.node").alias("node"), F.col("tree.top").alias("top"), F.col("tree").alias("tree"))
        level = level.groupBy(*keys, "block", *places[i + 1 :]).agg(F.sort_array(F.collect_list(child)).alias("children"))
        node = _digest(F.transform("children", lambda c: c["node"]))
        kids = F.transform("children", lambda c: c["tree"]).alias("kids")
        top = F.when(F.size("children") == 1, F.col("children")[0]["top"]).otherwise(F.col("node"))
        level = level.select(*keys, "block", *places[i + 1 :], kids, node.alias("node"), "children")
        level = level.select(*keys, "block", *places[i + 1 :], F.struct("node", top.alias("top"), "kids").alias("tree"))
    # Block 0 is either full or the only one of its group, whose root stands below its levels of one child.
    node = F.when(F.col("block") == 0, F.col("tree.top")).otherwise(F.col("tree.node"))
    return level.select(*keys, "block", "tree", node.alias("node"))


def _leaves(tree: Column, level: int, path: Column, bare: Column) -> Column:
    """Every leaf below ``tree`` with its siblings, lowest level first.

    ``bare``: no branching has been met on the way from the top of a lone block.
    """
    if level == 0:
        return F.array(F.struct(tree["own"].alias("own"), path.alias("path")))
    kids = tree["kids"]

    def below(kid: Column, i: Column) -> Column:
        nodes = F.transform(kids, lambda k: k["node"])
        step = F.struct(
            F.array_join(F.slice(nodes, F.lit(1), i), "").alias("left"), F.array_join(F.slice(nodes, i + 2, F.size(kids)), "").alias("right")
        )
        skipped = bare & (F.size(kids) == 1)
        return _leaves(kid, level - 1, F.concat(F.when(~skipped, F.array(step)).otherwise(F.array().cast(_PATH)), path), skipped)

    return F.flatten(F.transform(kids, below))


_PATH = "array<struct<left:string,right:string>>"


def _climb(items: DataFrame, keys: list[str], above: Above | None, arity: int, digits: int) -> DataFrame:
    """Per item ``keys``, ``own`` and ``up``: its path to the root, its group's root and the root of all."""
    blocks = materialize(_blocks(items, keys, arity, digits), "manifest_blocks")
    if (blocks.agg(F.max("block")).first()[0] or 0) > 0:
        parents = _climb(
            blocks.select(*keys, F.col("block").alias("rank"), "node", F.struct(F.col("block").alias("block")).alias("own")), keys, above, arity, digits
        ).select(*keys, "own.block", "up")
    elif above is not None:
        parents = above(blocks.select(*keys, "node")).withColumn("block", F.lit(0).cast("long"))
    else:
        path = F.array().cast(_PATH)
        parents = blocks.select(*keys, "block", F.struct(path.alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root")).alias("up"))
    kinds = StructType([*blocks.drop("node").schema.fields, parents.schema["up"]])
    halves = [
        half.select(*((F.col(f.name) if f.name in half.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in kinds)) for half in (blocks, parents)
    ]
    met = halves[0].unionByName(halves[1]).groupBy(*keys, "block").agg(
        F.first("tree", ignorenulls=True).alias("tree"), F.first("up", ignorenulls=True).alias("up")
    )
    found = met.select(
        *keys, "up", F.explode(_leaves(F.col("tree"), digits, F.array().cast(_PATH), F.col("block") == 0)).alias("leaf")
    )
    up = F.struct(F.concat("leaf.path", "up.path").alias("path"), F.col("up.subroot").alias("subroot"), F.col("up.root").alias("root"))
    return found.select(*keys, F.col("leaf.own").alias("own"), up.alias("up"))


def build_manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, told: Column | None = None,
    arity: int = ARITY, digits: int = BLOCK_DIGITS,
) -> DataFrame:
    """Per row ``id``, ``group``, ``leaf``, ``told``, ``path`` (per level the digests to the left and right), ``subroot``, ``root``.

    ``told`` is the digest that someone claims for the record, by default its own;
    ``verified`` folds it over the path.
    """
    leaf = record_digest([F.col(f"`{c}`") for c in fields])
    rows = docs.select(
        F.col(f"`{group_col}`").cast("string").alias("group"), F.col(f"`{id_col}`").cast("long").alias("id"), leaf.alias("node"),
        (leaf if told is None else told).alias("told"),
    )
    rows = _ranked(materialize(rows, "manifest_leaves"), ["group"], ["id", "node"])
    items = rows.select("group", "rank", "node", F.struct("id", F.col("node").alias("leaf"), "told").alias("own"))

    def above(groups: DataFrame) -> DataFrame:
        """The tree over the groups' roots."""
        ranked = _ranked(groups.withColumnRenamed("node", "subroot"), [], ["group"])
        tops = ranked.select("rank", F.col("subroot").alias("node"), F.struct("group", "subroot").alias("own"))
        return _climb(tops, [], None, arity, digits).select(
            "own.group", F.struct(F.col("up.path").alias("path"), F.col("own.subroot").alias("subroot"), F.col("up.root").alias("root")).alias("up")
        )

    return _climb(items, ["group"], above, arity, digits).select("own.id", "group", "own.leaf", "own.told", "up.path", "up.subroot", "up.root")


def proof_digests(path: Column) -> Column:
    """All siblings of a proof, level by level and left to right, as one string of digests."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))
