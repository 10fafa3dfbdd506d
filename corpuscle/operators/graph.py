"""Property-graph operators over (src, dst, type) edge tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.shared import cut

#: Levels that are kept apart before the visited nodes are written as one table again.
COMPACT = 16
#: A frontier of at most this many nodes is joined by broadcast.
NEAR = 200_000


def neighbors(edges: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """(node, other, type, side) of the edges of nodes(node)."""
    out = edges.join(nodes, edges["src"] == nodes["node"]).select("node", F.col("dst").alias("other"), "type", F.lit("out").alias("side"))
    back = edges.join(nodes, edges["dst"] == nodes["node"]).select("node", F.col("src").alias("other"), "type", F.lit("in").alias("side"))
    return {"out": out, "in": back}.get(direction, out.unionByName(back))


def adjacent(edges: DataFrame, nodes: DataFrame, relationship: str | None = None, direction: str = "both", limit: int = 100) -> DataFrame:
    """(node, other, type, side): each node's first edges by type, other end and side, of one relationship or of all.

    With both directions a loop counts once, as an edge that goes out.
    """
    own = edges if relationship is None else edges.where(F.col("type") == relationship)
    found = neighbors(own, nodes, direction)
    found = found.where(~((F.col("side") == "in") & (F.col("other") == F.col("node")))) if direction == "both" else found
    order = Window.partitionBy("node").orderBy("type", "other", "side")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def browse(edges: DataFrame, entities: DataFrame, relationship: str | None = None, confidence: str | None = None, language: str | None = None, source: str | None = None, terms: Sequence[str] = (), limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """Edges (key, src, dst, type) that pass all filters, the first by key, and the entities at their ends.

    edges(key, src, dst, type, confidence, sources array) pass a source filter if any of
    their sources is it; entities(entity, name, language) pass terms if the name of one
    end holds all of them, in any case, and a language filter if one end has it.
    """
    own = edges
    own = own if relationship is None else own.where(F.col("type") == relationship)
    own = own if confidence is None else own.where(F.col("confidence") == confidence)
    own = own if source is None else own.where(F.exists("sources", lambda s: s == source))
    low = F.lower("name")
    fits = F.lit(True)
    for t in terms:
        fits = fits & F.contains(low, F.lit(t.lower()))
    ends = entities.select("entity", fits.alias("named"), (F.lit(True) if language is None else F.coalesce(F.col("language") == language, F.lit(False))).alias("spoken"))
    end = lambda c: ends.select(F.col("entity").alias(c), F.col("named").alias(f"{c}_named"), F.col("spoken").alias(f"{c}_spoken"))
    met = own.join(end("src"), "src").join(end("dst"), "dst").where("(src_named or dst_named) and (src_spoken or dst_spoken)")
    first = cut(met.select("key", "src", "dst", "type").orderBy("key").limit(max(1, min(limit, 500))))
    seen = first.select(F.explode(F.array("src", "dst")).alias("entity")).distinct()
    return first, entities.join(F.broadcast(seen), "entity", "left_semi")  # at most 1,000 ends


def two_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, hop): seeds' undirected neighbours at distance one or two, seeds left out."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = lambda of: both.join(of.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
    one = cut(near(seeds).join(seeds, "node", "left_anti"))
    two = near(one).join(seeds, "node", "left_anti").join(one, "node", "left_anti")
    return one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2)))


def bfs(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None, directed: bool = False, ends: Sequence[str] = ()) -> DataFrame:
    """(node, hop, parent): breadth-first levels from seeds(node), a frontier at a time, to the last one, to max_hops or to the first with one of ends.

    The edges are written once, each in one direction. A frontier of at most NEAR nodes
    goes to the edges, which stay where they are; only a larger one is joined by
    shuffle. Each round drops what was visited and writes the new level. The parent is
    the smallest one of the level before.
    """
    once = cut(edges.select("src", "dst"))
    both = once if directed else once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    levels = [cut(seeds.select("node").distinct().select("node", F.lit(0).alias("hop"), F.lit(None).cast(seeds.schema["node"].dataType).alias("parent")))]
    frontier, hop = levels[0], 0
    size = frontier.count()
    while size and (max_hops is None or hop < max_hops):
        hop += 1
        own = frontier.select(F.col("node").alias("src"))
        step = both.join(F.broadcast(own) if size <= NEAR else own, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        visited = reduce(DataFrame.unionByName, levels)
        frontier = cut(step.join(visited.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hop"), "parent"))
        size = frontier.count()
        if not size:
            break
        levels.append(frontier)
        if ends and not frontier.where(F.col("node").isin(list(ends))).isEmpty():
            break
        if len(levels) > COMPACT:
            levels = [cut(reduce(DataFrame.unionByName, levels))]
    return reduce(DataFrame.unionByName, levels)


def shortest_path(edges: DataFrame, source: str | Sequence[str], target: str | Sequence[str], max_hops: int = 6) -> DataFrame:
    """(hop, node) rows of one undirected shortest path from any source to the nearest target, the smallest of equals.

    None if a source is a target or no path is short enough. The walk ends at the first level with a target.
    """
    spark = edges.sparkSession
    starts, ends = ([x] if isinstance(x, str) else list(x) for x in (source, target))
    path: list[tuple[int, str]] = []
    if not set(starts) & set(ends):
        levels = bfs(edges, spark.createDataFrame([(s,) for s in starts], "node string"), max_hops, ends=ends)
        at = levels.where(F.col("node").isin(ends)).orderBy("hop", "node").first()
        while at is not None:  # at most max_hops point look-ups
            path.append((at["hop"], at["node"]))
            at = levels.where(F.col("node") == at["parent"]).first() if at["parent"] is not None else None
    return spark.createDataFrame(path[::-1], "hop int, node string")


def dependents_closure(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node): everything that depends on a changed node, directly or not, and the changed nodes."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return bfs(turned, changed, directed=True).select("node")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, degree): distinct edges with the number of targets of their source; hubs stay many rows."""
    once = edges.select("src", "dst").distinct()
    return once.join(once.groupBy("src").agg(F.count("*").alias("degree")), "src")
