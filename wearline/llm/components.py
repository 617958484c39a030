"""Connected components of a link table, as Spark joins over star-shaped link sets.

Each round hangs the larger neighbours of every node on the smallest one it knows
("large star"), then hangs a node's smaller neighbours on the smallest ("small star").
Stars are fixed points.  A node's smallest neighbour is a pre-aggregated minimum joined
back to the links, so a node with very many links is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.session import cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u")
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in a link, the component being the smallest id it reaches.

    Links may repeat, come in either direction or join an id with itself; ids that are in no
    link to another id get no row.  An empty table gives an empty result.
    """
    stars = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    seen = None
    while True:
        print_of = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_of == seen or print_of[0] == 0:
            break
        seen = print_of
        stars = cut(_small_star(_large_star(stars)))
    roots = stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
