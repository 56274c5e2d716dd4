"""Calibration, validation and benchmark splits of exact sizes."""

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list) -> DataFrame:
    """``pos``: the rank from 0 in a total order, without bringing all rows to one task. Range partitions are
    sorted and counted, and each row adds its partition's offset (one number per partition)."""
    ranged = df.repartitionByRange(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order).withColumn("part__", F.spark_partition_id())
    within = ranged.withColumn("in__", F.row_number().over(Window.partitionBy("part__").orderBy(*order)) - 1)
    sizes = ranged.groupBy("part__").agg(F.count("*").alias("n__"))
    offsets = sizes.withColumn("before__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n__")
    return within.join(F.broadcast(offsets), "part__").withColumn("pos", F.col("before__") + F.col("in__")).drop("part__", "in__", "before__")


def labelled(df: DataFrame, total, train: float, val: float) -> DataFrame:
    first = int(total * train)
    second = first + int(total * val)
    return df.withColumn("split", F.when(F.col("pos") < first, "calibration").when(F.col("pos") < second, "validation").otherwise("benchmark"))


def hash_split(df: DataFrame, id_col: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """``pos`` and ``split`` in the order of md5 of seed and id (then id): sizes are exact, and the same on any cluster."""
    keyed = df.withColumn("key__", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))))
    return labelled(numbered(keyed, ["key__", id_col]), df.count(), train, val).drop("key__")


def seeded_split(df: DataFrame, order: list, train: float = 0.8, val: float = 0.1, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """The same with the permutation that a Mersenne twister of this seed gives a list of the rows in ``order``.
    It's drawn on the driver, so this is for tables whose row count (not rows) fits there."""
    total = df.count()
    ranked = numbered(df, order)
    if shuffle:
        where = list(range(total))
        random.Random(seed).shuffle(where)
        moves = df.sparkSession.createDataFrame([(old, new) for new, old in enumerate(where)], "pos long, new__ long")
        ranked = ranked.join(moves, "pos").drop("pos").withColumnRenamed("new__", "pos")
    return labelled(ranked, total, train, val)
