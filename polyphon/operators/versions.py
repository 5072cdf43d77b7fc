"""When model snapshots are taken, published, kept and restored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from polyphon.operators.orbit import orbit
from polyphon.operators.prefix import Running, running

NO_VERSION = -1


def snapshot_due(version: Column, pending: int) -> Column:
    """The plain rule: every ``pending`` versions."""
    return version % F.lit(pending) == 0


def checkpoint_plan(versions: DataFrame, pending: int = 100) -> DataFrame:
    """Versions at which a snapshot is requested.

    A request needs ``version % pending = 0`` and the *previous request* to be
    published by then. ``versions`` has ``version`` and ``published_at``: the
    version at which a snapshot requested now would be published (null if
    never). A slow publish therefore skips the candidates in between.
    """
    due = versions.where(snapshot_due(F.col("version"), pending))
    ready = F.greatest(F.col("version") + 1, F.col("published_at"))
    nxt = F.when(F.col("published_at").isNotNull(), (F.ceil(ready / F.lit(pending)) * pending).cast("long"))
    nodes = due.select(F.lit(0).alias("stream"), "version", nxt.alias("next_version"))
    return orbit(nodes, ["stream"], "version", "next_version").join(due, "version").select(*versions.columns)


def can_persist(version: Column, last_saved: Column, published: Column, first_save: Column) -> Column:
    """A part may save: a newer version whose predecessor is published, or its first save."""
    return first_save | ((last_saved < version) & (published >= last_saved))


def persist_gate(requests: DataFrame) -> DataFrame:
    """Snapshot requests that each part really saves.

    ``requests`` has ``part, version`` and ``next_ok``: the part's first later
    request at which *this* version, if saved, is published. A part's first
    request is always saved.
    """
    return orbit(requests, ["part"], "version", "next_ok")


def publish_barrier(reports: DataFrame, parts: int) -> DataFrame:
    """Versions that all parts have reported, and when the last one did.

    A repeated report of one part counts once. ``reports`` has ``version, part,
    seq``.
    """
    first = reports.groupBy("version", "part").agg(F.min("seq").alias("seq"))
    return (
        first.groupBy("version")
        .agg(F.count(F.lit(1)).alias("_parts"), F.max("seq").alias("published_seq"))
        .where(F.col("_parts") == parts)
        .drop("_parts")
    )


def version_pointer(published: DataFrame) -> DataFrame:
    """Current version, as one row; -1 when nothing is published."""
    return published.agg(F.coalesce(F.max("version"), F.lit(NO_VERSION)).cast("long").alias("version"))


def retain_two(members: DataFrame, keep: int = 2) -> DataFrame:
    """Rows of the newest ``keep`` distinct versions of each member.

    A member may have very many versions, so they are not ranked in one place:
    each pass takes the largest version below the last pass's, as a grouped
    maximum that combines map-side.
    """
    pairs = members.select("member", "version")
    newest = pairs.groupBy("member").agg(F.max("version").alias("version"))
    kept = newest
    for _ in range(keep - 1):
        below = pairs.join(newest.withColumnRenamed("version", "_last"), "member").where(F.col("version") < F.col("_last"))
        newest = below.groupBy("member").agg(F.max("version").alias("version"))
        kept = kept.unionByName(newest)
    return members.join(kept, ["member", "version"], "left_semi")


def restore_all_or_nothing(members: DataFrame, part_sizes: DataFrame) -> DataFrame:
    """Version each part restores: its newest one with every member present.

    ``members`` has ``part, member, version``; ``part_sizes`` has ``part,
    n_members``. A part with no complete version starts fresh (-1).
    """
    counts = members.select("part", "member", "version").distinct().groupBy("part", "version").agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.join(part_sizes, "part").where(F.col("_n") == F.col("n_members"))
    best = whole.groupBy("part").agg(F.max("version").alias("version"))
    return part_sizes.join(best, "part", "left").select(
        "part", F.coalesce(F.col("version"), F.lit(NO_VERSION)).cast("long").alias("version")
    )


def model_replace(stream: DataFrame, is_reset: str, order: str = "seq") -> DataFrame:
    """Rows the current model was trained on: those after the last replacement.

    Only the position of the last replacement matters, which is one maximum; the
    filter then prunes the scan. Replacement rows themselves train nothing.
    """
    last = stream.where(is_reset).agg(F.coalesce(F.max(order), F.lit(-1).cast("long")).alias("last"))
    return stream.where(F.col(order) > last.scalar()).where(f"NOT ({is_reset})")


def known_kinds(stream: DataFrame, kind: str, kinds: tuple[str, ...] = ("instance", "model", "evaluator")) -> DataFrame:
    """The stream itself; a row of any other kind stops the job."""
    known = F.coalesce(F.col(kind).isin(list(kinds)), F.lit(False))
    return stream.where(F.when(known, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit("null")))).cast("boolean")
    ))


def replace_in_stream(stream: DataFrame, kind: str = "kind", order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Instances the current model was trained on, and those the current evaluator has seen.

    A row of kind ``model`` brings a new model and resets what it was trained
    on; ``evaluator`` does the same for the evaluator, and leaves the model.
    """
    checked = known_kinds(stream, kind)
    instances = F.col(kind) == "instance"
    trained = model_replace(checked, f"{kind} = 'model'", order).where(instances)
    judged = model_replace(checked, f"{kind} = 'evaluator'", order).where(instances)
    return trained, judged


def epochs(stream: DataFrame, is_reset: str, order: str = "seq") -> DataFrame:
    """Number of replacements (rows where the SQL condition holds) up to each row."""
    return running(stream, order, [Running("epoch", f"CASE WHEN {is_reset} THEN 1L ELSE 0L END")])
