"""Connected components by repeated contraction along a random order of the nodes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): root is the least node reachable. Isolated nodes have no row.

    Nodes are ordered by a hash, so no numbering of theirs makes long descending paths. In each round a node goes
    to the least node of its neighbourhood and, from there, to the least one of that node's. A chain keeps
    about two fifths of its nodes, a star ends after two rounds: a chain of 1,000 links takes about 8. The maps
    of the rounds, all written tables, are then composed. Loops and repeated links are allowed; nulls are ignored.
    """
    edges = edges.select("a", "b").where("a <> b")
    maps = []
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("up"))).alias("x"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("up"))
        nearest = written(nearest.select("node", F.least(own, F.col("x"))["up"].alias("up")), "cc-nearest")
        if nearest.isEmpty():
            break
        two = nearest.join(nearest.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up").select("node", F.col("up2").alias("up"))
        maps.append(written(two, "cc-map"))
        left = maps[-1].select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = maps[-1].select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = edges.join(left, "a").join(right, "b").where("ua <> ub")
        edges = written(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "cc-links")
    if not maps:
        return nearest.select("node", F.col("up").alias("root"))
    out = maps[0].select("node", F.col("up").alias("end"))
    for later in maps[1:]:
        step = later.select(F.col("node").alias("end"), F.col("up").alias("_up"))
        out = out.join(step, "end", "left").select("node", F.coalesce("_up", "end").alias("end"))
    out = written(out, "cc-ends")
    return written(out.join(out.groupBy("end").agg(F.min("node").alias("root")), "end").select("node", "root"), "cc-roots")


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots (node, root) of components after further links (a, b), a written table: only their roots are contracted."""
    if links.isEmpty():
        return roots
    named = links
    for end in "ab":
        named = named.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    more = components(named.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("_new")), "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
    return written(moved.unionByName(more.join(roots, "node", "left_anti").select("node", "root")), "cc-roots")
