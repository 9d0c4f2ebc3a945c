"""Harmonic centrality of hosts, exactly and by HyperBall.

A vertex scores 1 / distance for every other vertex that reaches it along edges
(src, dst).  Both are loops of joins on the driver; each round is written to the
shared folder, so a lost executor costs one round, and the plan does not grow.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import tables


def in_neighbours(edges: DataFrame) -> DataFrame:
    """(vertex, neighbour): the edges backwards."""
    return edges.select(F.col("dst").alias("vertex"), F.col("src").alias("neighbour")).distinct()


def harmonic_exact(vertices: DataFrame, edges: DataFrame, depth: int | None = None, vertex: str = "host") -> DataFrame:
    """(vertex, harmonic): breadth-first from all vertices at once, to at most ``depth`` steps; without it until nothing new is reached.

    The visited pairs are as many as there are pairs in reach, so this is for
    small graphs or small depths; ``hyper_ball`` is for large ones.
    """
    spark = vertices.sparkSession
    back, back_path = tables.cut(in_neighbours(edges), "in-neighbours")
    frontier = vertices.select(F.col(vertex).alias("vertex"), F.col(vertex).alias("reached"))
    levels = [tables.cut(frontier.withColumn("level", F.lit(0)), "level")]
    for level in itertools.count(1) if depth is None else range(1, depth + 1):
        visited = levels[0][0]
        for df, _ in levels[1:]:
            visited = visited.unionByName(df)
        step = levels[-1][0].join(back.withColumnRenamed("vertex", "reached"), "reached").select("vertex", F.col("neighbour").alias("reached")).distinct()
        new = step.join(visited.select("vertex", "reached"), ["vertex", "reached"], "left_anti")
        levels.append(tables.cut(new.withColumn("level", F.lit(level)), "level"))
        if levels[-1][0].isEmpty():
            break
    tables.remove(spark, back_path)
    reached = levels[1][0] if len(levels) > 1 else levels[0][0].where("false")
    for df, _ in levels[2:]:
        reached = reached.unionByName(df)
    sums, _ = tables.cut(reached.groupBy("vertex").agg(F.sum(1 / F.col("level")).alias("harmonic")), "harmonic")
    for _, path in levels:
        tables.remove(spark, path)
    return vertices.select(F.col(vertex).alias("vertex")).join(sums, "vertex", "left").select(F.col("vertex").alias(vertex), F.coalesce("harmonic", F.lit(0.0)).alias("harmonic"))


def hyper_ball(vertices: DataFrame, edges: DataFrame, precision: int = 10, vertex: str = "host", most_rounds: int = 1000) -> DataFrame:
    """(vertex, harmonic): each vertex keeps a sketch of who reaches it in t steps, and what a round adds counts 1 / t.

    All sketches of a round come from those of the round before, so the result does
    not depend on the order of tasks.  It ends when no estimate changes, and is an
    error if that takes more than ``most_rounds``.  A round
    shuffles a sketch for each edge, combined before the shuffle.
    """
    spark = vertices.sparkSession
    back, back_path = tables.cut(in_neighbours(edges), "in-neighbours")
    first = vertices.select(F.col(vertex).alias("vertex")).groupBy("vertex").agg(F.hll_sketch_agg("vertex", F.lit(precision)).alias("ball"))
    now, path = tables.cut(first.select("vertex", "ball", F.hll_sketch_estimate("ball").alias("n"), F.lit(0.0).alias("harmonic")), "balls")
    for t in range(1, most_rounds + 1):
        sent = back.join(now.select(F.col("vertex").alias("neighbour"), "ball"), "neighbour").select("vertex", "ball")
        grown = sent.unionByName(now.select("vertex", "ball")).groupBy("vertex").agg(F.hll_union_agg("ball").alias("ball"))
        both = grown.join(now.select("vertex", F.col("n").alias("old"), "harmonic"), "vertex").withColumn("n", F.hll_sketch_estimate("ball"))
        new = both.select("vertex", "ball", "n", (F.col("harmonic") + F.greatest(F.col("n") - F.col("old"), F.lit(0)) / F.lit(float(t))).alias("harmonic"), (F.col("n") != F.col("old")).alias("changed"))
        old = path
        now, path = tables.cut(new, "balls")
        tables.remove(spark, old)
        if not now.agg(F.bool_or("changed")).first()[0]:
            break
    else:
        raise RuntimeError(f"estimates still change after {most_rounds} rounds")
    tables.remove(spark, back_path)
    return now.select(F.col("vertex").alias(vertex), "harmonic")


def normalised(centrality: DataFrame) -> DataFrame:
    """The harmonic divided by the number of vertices."""
    n = centrality.agg(F.count(F.lit(1)).alias("__n"))
    return centrality.crossJoin(F.broadcast(n)).withColumn("harmonic", F.col("harmonic") / F.col("__n")).drop("__n")
