"""Feature headers and the instance views of the given tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from polyphon.functions.timeutil import epoch_ms

# An attribute with more values than this is completed as an open one.
DECLARED_VALUES = 256


@dataclass(frozen=True)
class FeatureSpec:
    """The header of an instance stream: columns, kinds and declared values.

    ``classes`` fixes the order of a vote vector. ``nominal`` maps a column to
    its declared values. The values of ``open`` columns are not declared: there
    may be any number of them, and the learner counts those it meets.
    """

    numeric: tuple[str, ...] = ()
    nominal: dict[str, tuple[str, ...]] = field(default_factory=dict)
    open: tuple[str, ...] = ()
    label: str = "label"
    classes: tuple[str, ...] = ()
    weight: str = "weight"

    @property
    def model_cells(self) -> int:
        """Numbers in one member's model; the size bound used for broadcasts."""
        per_class = 3 + 4 * len(self.numeric) + 2 * sum(len(v) for v in self.nominal.values())
        return len(self.classes) * per_class

    def class_index(self, label: Column) -> Column:
        """Position of a label in ``classes``, null when it is not declared."""
        idx = F.array_position(F.array(*[F.lit(c) for c in self.classes]), label)
        return F.when(idx > 0, (idx - 1).cast("int"))

    def class_at(self, index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(c) for c in self.classes]), index + 1)


def declared_values(df: DataFrame, column: str, most: int | None = None) -> tuple[str, ...] | None:
    """Distinct values of a header column, sorted; None when there are more than ``most``."""
    found = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull()).distinct()
    rows = (found if most is None else found.limit(most + 1)).collect()
    return None if most is not None and len(rows) > most else tuple(sorted(r.v for r in rows))


def complete_header(df: DataFrame, spec: FeatureSpec, most: int = DECLARED_VALUES) -> FeatureSpec:
    """Fill undeclared classes and nominal values from the data.

    A nominal attribute with more than ``most`` values becomes an open one, so
    that what the driver and the model's constants hold stays bounded. A vote
    vector has one place per class, so classes are always declared.
    """
    classes = spec.classes or declared_values(df, spec.label)
    found = {c: vals or declared_values(df, c, most) for c, vals in spec.nominal.items()}
    nominal = {c: vals for c, vals in found.items() if vals is not None}
    return replace(spec, classes=classes, nominal=nominal, open=(*spec.open, *(c for c in found if c not in nominal)))


def events_instances(events: DataFrame) -> DataFrame:
    """Instance view of ``events``.

    Amounts are whole cents held as doubles: sums of whole numbers are exact in
    any order, so results do not depend on how Spark splits the work.
    """
    return events.select(
        F.col("event_id").alias("instance_id"),
        F.col("event_id").alias("seq"),
        epoch_ms(events, "ts").alias("ts_ms"),
        F.lit(1.0).alias("weight"),
        F.round(F.col("value") * 100).alias("x_cents"),
        F.get_json_object("props", "$.k").cast("double").alias("x_k"),
        F.pmod(F.col("user_id"), F.lit(5)).cast("string").alias("n_user"),
        F.col("event_type").alias("label"),
        F.col("user_id"),
        F.col("user_id").cast("string").alias("o_user"),
    )


EVENTS_SPEC = FeatureSpec(numeric=("x_cents", "x_k"), nominal={"n_user": ()})


def lineitem_instances(lineitem: DataFrame) -> DataFrame:
    """Bulk training view of ``lineitem``; the table has no key and needs none."""
    return lineitem.select(
        F.lit(1.0).alias("weight"),
        F.col("l_quantity").alias("x_quantity"),
        F.round(F.col("l_discount") * 100).alias("x_discount"),
        F.round(F.col("l_tax") * 100).alias("x_tax"),
        F.col("l_linestatus").alias("n_status"),
        F.col("l_returnflag").alias("label"),
        F.col("l_suppkey").cast("string").alias("o_supplier"),
    )


LINEITEM_SPEC = FeatureSpec(numeric=("x_quantity", "x_discount", "x_tax"), nominal={"n_status": ()})


def orders_instances(orders: DataFrame) -> DataFrame:
    """Second labelled stream."""
    return orders.select(
        F.col("o_orderkey").alias("instance_id"),
        F.col("o_orderkey").alias("seq"),
        F.lit(1.0).alias("weight"),
        F.round(F.col("o_totalprice") * 100).alias("x_cents"),
        F.col("o_orderstatus").alias("n_status"),
        F.col("o_orderpriority").alias("label"),
        F.col("o_custkey").cast("string").alias("o_customer"),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
