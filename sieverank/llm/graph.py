"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _written(rows: DataFrame) -> DataFrame:
    """The rows, written into the checkpoint folder and read again. A checkpoint would keep the size that the optimizer
    guesses, for a join the product of both sides: its digits grow threefold each round, and from the tenth round on
    planning takes longer than the work."""
    spark = rows.sparkSession
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/components-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of `links`; root names the component: two nodes have one root if links connect them.

    Each round every node points to its smallest neighbour, if that is smaller, and the graph is contracted along these
    pointers: links within a class go, so the rounds shrink fast. The pointers of all rounds are then put together from
    the last to the first. Nothing is collected but whether links are left; each round is written out, so a lost
    executor costs one round. Minima are combined before each shuffle, and hub keys only occur on join sides that
    adaptive execution can split. Nulls on either side and links of a node to itself add nothing.
    """
    ends = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = _written(ends.filter(ends[2]).select("a", "b").distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = _written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")))
        rounds.append(up)
        of_a, of_b = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        across = edges.join(of_a, "a").join(of_b, "b").select("x", "y")
        # A node that others point to may point on itself: that is a link of the next round.
        onward = up.select(F.col("up").alias("a")).distinct().join(of_a, "a").select(F.col("a").alias("x"), F.col("x").alias("y"))
        edges = _written(across.union(onward).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[-1].select("node", F.col("up").alias("root"))
    for up in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("up"), "root")
        roots = up.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return _written(roots)


def least_ids(nodes: DataFrame, roots: DataFrame, salts: int = 16) -> DataFrame:
    """node, component_id: the smallest `least` in each node's component; nodes(node, least), roots as of components().

    A large component is one root on many rows: its rows are dealt out under `salts` numbers, and the table of minima,
    one row a component, is repeated for each of them.
    """
    labelled = nodes.join(roots, "node", "left")
    alone = labelled.filter("root is null").select("node", F.col("least").alias("component_id"))
    linked = labelled.filter("root is not null").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return alone.unionByName(linked.join(least, ["root", "salt"]).select("node", "component_id"))
