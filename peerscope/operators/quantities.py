"""Unit conversion of whole tables: the label of a unit is read once per distinct label, not once per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.functions.units import to_float, unit_factor
from peerscope.operators.ranking import join_null_safe


def convert_quantities(df: DataFrame, quantity: Column, unit: Column, factors: Mapping[str, float]) -> DataFrame:
    """Add value and recognized, by the rules of ``functions.units.convert_quantity``.

    Distinct labels (combined where they are read) get their factor and meet the rows; their table is broadcast only if it is small.
    """
    rows = df.withColumn("_unit", unit).withColumn("_amount", to_float(quantity))
    labels = rows.select("_unit").distinct().withColumn("_factor", unit_factor(F.col("_unit"), factors))
    met = join_null_safe(rows, labels, ["_unit"], "left")
    zero = F.col("_amount") == 0
    value = F.when(zero, F.lit(0.0)).otherwise(F.col("_amount") * F.col("_factor"))
    known = F.col("_amount").isNull() | zero | F.col("_factor").isNotNull()
    return met.withColumn("value", value).withColumn("recognized", known).drop("_unit", "_amount", "_factor")
