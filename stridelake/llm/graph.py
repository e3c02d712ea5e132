"""Connected components of a graph in Spark."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from stridelake.llm.store import Kept


#: Edges of a node that meet in one place at least; a node with more is a hub, and there are no more than ``2 * HUBS`` of them.
HUB_EDGES, HUBS = 1000, 100_000


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of an undirected graph given as distinct or repeated pairs ``a, b`` of longs; ``root`` is the smallest node reached.

    Every round, each node tells its smallest neighbour to all its larger ones and then the other way (large star, small
    star): hubs shrink quickly and rounds are few.  A group of any size is handled by minimum aggregates and joins,
    never as a list, and the edges of a hub are dealt to several tasks.  Each round is written to the shared folder, so
    lineage stays short.
    """
    pairs = Kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, count = None, pairs.df.count()
    while True:
        many = max(HUB_EDGES, count // HUBS)
        next_ = Kept(_small_star(_large_star(pairs.df, many), many), "edges")
        pairs.release()
        pairs = next_
        # Once every edge leads to a root, the set of edges does not change any more.
        state = pairs.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, count = state, state[0]


def _with_least(directed: DataFrame, least: Column, many: int) -> DataFrame:
    """``n, m, least``: each edge with what its node's neighbours agree on.

    Hubs, nodes of more than ``many`` edges, are few enough to be broadcast; their edges are dealt by the other end, and
    their row is repeated for each share.
    """
    nodes = directed.groupBy("n").agg(least.alias("least"), F.ceil(F.count("*") / many).cast("int").alias("shares"))
    hubs = F.broadcast(nodes.where("shares > 1").select("n", "shares"))
    dealt = directed.join(hubs, "n", "left").select("n", "m", F.pmod(F.xxhash64("m"), F.coalesce("shares", F.lit(1))).cast("int").alias("share"))
    spread = nodes.select("n", "least", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    return dealt.join(spread, ["n", "share"]).drop("share")


def _large_star(pairs: DataFrame, many: int) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    both = pairs.select(F.col("a").alias("n"), F.col("b").alias("m")).union(pairs.select(F.col("b").alias("n"), F.col("a").alias("m")))
    joined = _with_least(both, F.least(F.col("n"), F.min("m")), many)
    return joined.where("m > n").select(F.col("m").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(pairs: DataFrame, many: int) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = pairs.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("m"))
    joined = _with_least(down, F.min("m"), many)
    links = joined.select(F.col("m").alias("a"), F.col("least").alias("b")).union(joined.select(F.col("n").alias("a"), F.col("least").alias("b")))
    return links.where("a <> b").distinct()
