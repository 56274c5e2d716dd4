"""Connected components by alternating large and small stars, on DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

HUB_SHARE = 1000
PIECE_SHARE = 4000


def with_least(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` (columns ``u``, ``v``) with ``m``, the least of each ``u`` and its neighbours ``v``.

    A hub, i.e. a node with over 1 / HUB_SHARE of the ``total`` edges, has them dealt to pieces of about 1 / PIECE_SHARE of all, so
    no key brings a task more. There are fewer than HUB_SHARE hubs at any size, which bounds their broadcast; together they make fewer
    than PIECE_SHARE + HUB_SHARE pieces. They're looked up by a hash, as a map of longs takes executors its few bytes and one of
    binary keys a memory page; a node that shares a hub's hash is dealt likewise, on both sides.
    """
    near = edges.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")).select("u", F.least("u", "least").alias("m"), "n")
    at = F.xxhash64("u").alias("at")
    hubs = near.where(F.col("n") * HUB_SHARE > total).select(at, F.least("n", F.ceil(F.col("n") * PIECE_SHARE / total)).cast("int").alias("pieces")).groupBy("at").agg(F.max("pieces").alias("pieces"))
    pieces = F.coalesce("pieces", F.lit(1))
    dealt = edges.select("*", at).join(F.broadcast(hubs), "at", "left").select("u", "v", F.pmod(F.xxhash64("v"), pieces).cast("int").alias("piece"))
    targets = near.select("*", at).join(F.broadcast(hubs), "at", "left").select("u", "m", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    return dealt.join(targets, ["u", "piece"]).select("u", "v", "m")


def are_stars(edges: DataFrame) -> bool:
    """Whether each ``u`` of ``edges`` (distinct, ``u`` greater than ``v``) has one ``v`` that is no ``u``, so all hang on their
    component's least node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 and n > 1").limit(1).count()


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's least node) for every node of ``edges`` (columns ``u``, ``v`` of one
    orderable type) other than the roots themselves.

    A round hangs each node's larger neighbours, and then its smaller ones, on the least of them; the edges
    end as stars around the roots after about log^2 rounds, and edges that are stars take none. Each round's edges are a table
    in the shared folder. Loops and repeated edges don't matter; without edges there are no rows.
    """
    stars = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    while not are_stars(stars):
        total = stars.count()
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "stars")
        hung = with_least(large, large.count()).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        stars = written(hung.distinct(), "stars")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
