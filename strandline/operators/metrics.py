"""Structural metrics of the topology, all as rounds of joins on the edge list.

Every loop cuts its lineage through the shared checkpoint folder, so lost
executors cost one round at most. ``edges`` is the simple undirected edge list
(a, b) of ``EvidenceGraph.topology``; every node in it has an edge.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.graph import EvidenceGraph
from strandline.operators.order import ordered
from strandline.operators.skew import HOT_ROWS, hot_keys, lookup_join
from strandline.session import cut, cut_count, drop_cut

DAMPING = 0.85
ROUNDS = 50
#: Edges up to which the edge list is broadcast for betweenness: 16 MB, and some 80 MB as lists in each worker.
BROADCAST_EDGES = 1_000_000
#: Edges up to which one task works out ``structure``: some 500 MB of arrays.
TASK_EDGES = 6_000_000
#: Sources times nodes that betweenness by joins works on at once.
PAIRS = 50_000_000


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst of every edge in both directions."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def degree(edges: DataFrame) -> DataFrame:
    """id, degree."""
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest member), size.

    In a round every node takes the least label around it, labels jump to their
    label's label twice, and edges are redrawn between labels; those within one
    label vanish, so a round works on what is left only. Labels never rise and
    stay within their component; when no edge is left each component has one
    label, its smallest member. The rounds' labels are put together at the end.
    """
    left, n = cut_count(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    rounds = []
    while n or not rounds:
        least = cut(both_ways(left).groupBy(F.col("src").alias("v")).agg(F.min(F.least("src", "dst")).alias("m")))
        label = least
        for _ in range(2):
            label = label.join(least.select(F.col("v").alias("m"), F.col("m").alias("_up")), "m").select("v", F.col("_up").alias("m"))
        label = cut(label, least)
        rounds.append(label)
        at = lambda end, name: label.select(F.col("v").alias(end), F.col("m").alias(name))  # noqa: B023, E731
        hot = {end: hot_keys(left, [end]) if n > HOT_ROWS else [] for end in "ab"}
        drawn = lookup_join(lookup_join(left, at("a", "x"), ["a"], hot=hot["a"]), at("b", "y"), ["b"], hot=hot["b"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left, n = cut_count(drawn, left)
    label = rounds[-1]
    for own in reversed(rounds[:-1]):
        label = own.join(label.select(F.col("v").alias("m"), F.col("m").alias("_up")), "m", "left").select("v", F.coalesce("_up", "m").alias("m"))
    sizes = label.groupBy("m").agg(F.count(F.lit(1)).alias("size"))
    return label.join(sizes, "m").select(F.col("v").alias("id"), F.col("m").alias("component"), "size")


def pagerank(edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, every: int = 10, nodes: int | None = None) -> DataFrame:
    """id, pagerank after a fixed number of rounds from an even start. No node is without an edge.

    ``nodes``: how many nodes the graph has in all, where ``edges`` are some of its components.
    """
    ways = both_ways(edges)
    ways = cut(ways.join(degree(edges).withColumnRenamed("id", "src"), "src").select("src", "dst", (F.lit(1.0) / F.col("degree")).alias("share")))
    n = ways.select("src").distinct().count() if nodes is None else nodes
    hot = hot_keys(ways, ["src"])
    rank = ways.select(F.col("src").alias("id")).distinct().withColumn("pagerank", F.lit(1.0 / max(n, 1)))
    written: tuple[DataFrame, ...] = ()
    for i in range(rounds):
        flow = lookup_join(ways, rank.withColumnRenamed("id", "src"), ["src"], hot=hot).groupBy("dst").agg(F.sum(F.col("pagerank") * F.col("share")).alias("in"))
        rank = flow.select(F.col("dst").alias("id"), (F.lit((1 - damping) / max(n, 1)) + F.lit(damping) * F.col("in")).alias("pagerank"))
        if (i + 1) % every == 0:
            rank = cut(rank, *written)
            written = (rank,)
    return rank


def core_numbers(edges: DataFrame) -> DataFrame:
    """id, core: every node's number falls to the h-index of its neighbours' numbers until none falls."""
    ways = cut(both_ways(edges))
    hot = hot_keys(ways, ["dst"])
    state = cut(degree(edges).select("id", F.col("degree").cast("long").alias("core")))
    while True:
        core = state.select("id", "core")
        near = lookup_join(ways, core.withColumnRenamed("id", "dst"), ["dst"], hot=hot).groupBy("src", "core").agg(F.count(F.lit(1)).alias("n"))
        # Counts by value, not neighbours, are gathered: as many entries as there are distinct core numbers around a node.
        lists = near.groupBy("src").agg(F.array_sort(F.collect_list(F.struct((-F.col("core")).alias("v"), "n"))).alias("seen"))
        step = F.aggregate("seen", F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("total")), lambda acc, x: F.struct(F.greatest(acc["h"], F.least(acc["total"] + x["n"], -x["v"])).alias("h"), (acc["total"] + x["n"]).alias("total")))
        new = core.join(lists, F.col("id") == F.col("src")).select("id", F.col("core").alias("old"), F.least("core", step["h"]).alias("core"))
        state, fell = cut_count(new, state, where="core <> old")
        if not fell:
            return state.select("id", "core")


def betweenness(edges: DataFrame, limit: int = BROADCAST_EDGES, pairs: int = PAIRS) -> DataFrame:
    """id, betweenness: exact, unweighted, scaled by 1 / ((n - 1)(n - 2)).

    Nodes are numbered first. Up to ``limit`` edges the edge list is broadcast
    and sources are shared out over the tasks; beyond, sources advance level by
    level in joins, so many at a time that sources times nodes are ``pairs``.
    """
    names, n, numbered, m = _numbered(edges)
    if n <= 2:
        return names.select("id", F.lit(0.0).alias("betweenness"))
    sums = _brandes(numbered, names.select("v"), n) if m <= limit else _brandes_joined(numbered, names.select("v"), max(1, pairs // n), n)
    return names.join(sums, "v", "left").select("id", (F.coalesce("total", F.lit(0.0)) / F.lit(float((n - 1) * (n - 2)))).alias("betweenness"))


def _numbered(edges: DataFrame) -> tuple[DataFrame, int, DataFrame, int]:
    """id, v of the nodes, numbered in order of their ids, and how many; x, y of the edges, and how many."""
    names, n = cut_count(ordered(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "v", "id").select("id", F.col("v").cast("int").alias("v")))
    number = lambda end, name: names.select(F.col("id").alias(end), F.col("v").alias(name))
    return names, n, *cut_count(edges.join(number("a", "x"), "a").join(number("b", "y"), "b").select("x", "y"))


def structure(edges: DataFrame, limit: int = TASK_EDGES, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """id, degree, component, size, core, pagerank: as of the functions for each, which take over beyond ``limit`` edges; up to it one task has the whole edge list."""
    names, n, numbered, m = _numbered(edges)
    if m > limit:
        return degree(edges).join(components(edges), "id").join(core_numbers(edges), "id").join(pagerank(edges, rounds, damping), "id")

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = (np.concatenate(ends) for ends in zip(*[[part.column(i).to_numpy() for i in (0, 1)] for part in parts]))
        found = _structure(x, y, n, rounds, damping)
        for start in range(0, n, 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[start : start + 100_000]) for c in found], names=["v", "degree", "c", "size", "core", "pagerank"])

    if not m:
        return names.select("id", F.lit(0).cast("long").alias("degree"), F.col("id").alias("component"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("core"), F.lit(0.0).alias("pagerank"))
    found = cut(numbered.coalesce(1).mapInArrow(run, "v int, degree long, c int, size long, core long, pagerank double"))
    return found.join(names, "v").join(names.select(F.col("v").alias("c"), F.col("id").alias("component")), "c").select("id", "degree", "component", "size", "core", "pagerank")


def _structure(x: np.ndarray, y: np.ndarray, n: int, rounds: int, damping: float) -> tuple[np.ndarray, ...]:
    """Number, degree, least number of its component and the component's size, core number and PageRank of nodes 0 to n - 1, each of which has an edge."""
    src, dst = np.concatenate((x, y)), np.concatenate((y, x))
    degrees = np.bincount(src, minlength=n)
    label = np.arange(n)
    while True:
        at_x, at_y = label[x], label[y]
        if np.array_equal(at_x, at_y):
            break
        least = np.minimum(at_x, at_y)
        np.minimum.at(label, at_x, least)
        np.minimum.at(label, at_y, least)
        while not np.array_equal(up := label[label], label):
            label = up
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        rank = (1 - damping) / n + damping * np.bincount(src, (rank / degrees)[dst], n)
    to = dst[np.argsort(src, kind="stable")]
    del src, dst
    return np.arange(n, dtype=np.int32), degrees, label.astype(np.int32), np.bincount(label, minlength=n)[label], _cores(degrees, to), rank


def _cores(degrees: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Core numbers by peeling; ``to`` has the neighbours of each node in turn."""
    first = np.cumsum(degrees) - degrees
    core, left, alive = np.zeros(len(degrees), np.int64), degrees.copy(), np.ones(len(degrees), bool)
    k = 0
    while alive.any():
        k = max(k, int(left[alive].min()))
        front = np.flatnonzero(alive & (left <= k))
        while len(front):
            core[front], alive[front] = k, False
            sizes = degrees[front]
            near = to[np.repeat(first[front] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            hit, times = np.unique(near[alive[near]], return_counts=True)
            left[hit] -= times
            front = hit[left[hit] <= k]
    return core


def _brandes(edges: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    table = edges.toArrow()  # two 32-bit numbers for each of at most BROADCAST_EDGES
    x, y = (table.column(c).to_numpy() for c in ("x", "y"))
    src, dst = np.concatenate((x, y)), np.concatenate((y, x))
    order = np.argsort(src, kind="stable")
    first = np.searchsorted(src[order], np.arange(n + 1)).astype(np.int64)
    shared = edges.sparkSession.sparkContext.broadcast((first, dst[order]))

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, to = shared.value
        near = [part.tolist() for part in np.split(to, first[1:-1])]
        total = np.zeros(len(near))
        for part in parts:
            for s in part["v"].tolist():
                _accumulate(s, near, total)
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"v": hit.astype(np.int32), "part": total[hit]})

    tasks = edges.sparkSession.sparkContext.defaultParallelism
    return sources.repartition(tasks).mapInPandas(run, "v int, part double").groupBy("v").agg(F.sum("part").alias("total"))


def _accumulate(s: int, near: list[list[int]], total: np.ndarray) -> None:
    """Add the dependencies of source ``s`` on all nodes."""
    dist, paths, order, before = {s: 0}, {s: 1.0}, [], {s: []}
    queue = deque([s])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in near[v]:
            if w not in dist:
                dist[w], paths[w], before[w] = dist[v] + 1, 0.0, []
                queue.append(w)
            if dist[w] == dist[v] + 1:
                paths[w] += paths[v]
                before[w].append(v)
    owed = dict.fromkeys(order, 0.0)
    for w in reversed(order):
        for v in before[w]:
            owed[v] += paths[v] / paths[w] * (1 + owed[w])
        if w != s:
            total[w] += owed[w]


def _brandes_joined(edges: DataFrame, sources: DataFrame, batch: int, n: int) -> DataFrame:
    """The same by joins, for ``batch`` sources at a time."""
    ways = cut(edges.select(F.col("x").alias("src"), F.col("y").alias("dst")).unionByName(edges.select(F.col("y").alias("src"), F.col("x").alias("dst"))))
    total = None
    for start in range(0, n, batch):
        part = _dependencies(ways, sources.where(F.col("v").between(start, start + batch - 1)))
        if part is not None:
            spent = () if total is None else (total,)
            total = cut((part if total is None else part.unionByName(total)).groupBy("v").agg(F.sum("total").alias("total")), *spent)
    return sources.select("v", F.lit(0.0).alias("total")) if total is None else total


def _dependencies(ways: DataFrame, sources: DataFrame) -> DataFrame | None:
    """v, total: dependencies of some sources. levels[d] has (s, v, sigma) of all nodes v at distance d from s."""
    levels = [cut(sources.select(F.col("v").alias("s"), "v", F.lit(1.0).alias("sigma")))]
    seen = levels[0].select("s", "v")
    while True:
        front = levels[-1].join(ways, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
        front, reached = cut_count(front.join(seen, ["s", "v"], "left_anti"))
        if not reached:
            break
        seen = front.select("s", "v").unionByName(levels[-1].select("s", "v"))  # an edge spans one level at most
        levels.append(front)
    owed, total = None, None
    for d in range(len(levels) - 1, 0, -1):
        own = levels[d].withColumn("delta", F.lit(0.0)) if owed is None else levels[d].join(owed, ["s", "v"], "left").fillna(0.0, ["delta"])
        own = cut(own)
        add = own.groupBy("v").agg(F.sum("delta").alias("total"))
        total = add if total is None else total.unionByName(add)
        up = own.join(ways, own["v"] == ways["src"]).select("s", F.col("dst").alias("v"), ((1 + F.col("delta")) / F.col("sigma")).alias("x"))
        owed = up.join(levels[d - 1], ["s", "v"]).groupBy("s", "v").agg(F.sum(F.col("x") * F.col("sigma")).alias("delta"))
    return total


def communities(edges: DataFrame) -> DataFrame:
    """id, community: Louvain by rounds, until no node gains by a move and no level merges anything.

    In a round every node proposes the neighbouring community of greatest gain;
    of equal gains the smallest community id wins. Half of the moves, chosen by
    a hash, are made at once; if modularity does not rise by them, which is
    compared exactly, only moves are made that share no community, whose gains
    add up. So modularity rises in every round, the loops end, and the result
    does not depend on partitioning. Communities are numbered from 0 by their
    smallest member.
    """
    member = cut(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("c", F.col("id")))
    graph = cut(both_ways(edges).withColumn("w", F.lit(1).cast("long")))
    two_m = graph.agg(F.sum("w")).first()[0] or 1
    while True:
        label = cut(graph.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("k")).withColumn("c", F.col("v")))
        hot = hot_keys(graph, ["dst"])
        near, quality = _toward(graph, label, two_m, hot)
        rounds = 0
        while True:
            moves = cut(_moves(label, near, two_m))
            if moves.isEmpty():
                break
            tried = _moved(label, moves.where(F.pmod(F.xxhash64("v", F.lit(rounds)), F.lit(2)) == 0))
            around, risen = _toward(graph, tried, two_m, hot)
            if risen <= quality:
                for x in (tried, around):
                    drop_cut(x)
                tried = _moved(label, _apart(moves))
                around, risen = _toward(graph, tried, two_m, hot)
            for x in (label, near, moves):
                drop_cut(x)
            label, near, quality = tried, around, risen
            rounds += 1
        if not rounds:
            break
        to = label.select("v", F.col("c").alias("c2"))
        member = cut(member.join(to, F.col("c") == F.col("v")).select("id", F.col("c2").alias("c")), member)
        graph = cut(graph.join(to.select(F.col("v").alias("src"), F.col("c2").alias("s2")), "src").join(to.select(F.col("v").alias("dst"), F.col("c2").alias("d2")), "dst").groupBy(F.col("s2").alias("src"), F.col("d2").alias("dst")).agg(F.sum("w").alias("w")), graph)
    first = member.groupBy("c").agg(F.min("id").alias("first"))
    return member.join(ordered(first, "community", "first").select("c", "community"), "c").select("id", "community")


def _toward(graph: DataFrame, label: DataFrame, two_m: int, hot: list[tuple]) -> tuple[DataFrame, int]:
    """v, to, w: the weight of every node's edges to every community; and the modularity, less what is the same in all rounds, times a constant."""
    other = label.select(F.col("v").alias("dst"), F.col("c").alias("to"))
    near = cut(lookup_join(graph.where("src <> dst"), other, ["dst"], hot=hot).groupBy(F.col("src").alias("v"), "to").agg(F.sum("w").alias("w")))
    within = near.join(label, (near["v"] == label["v"]) & (near["to"] == label["c"])).agg(F.sum("w").alias("within"))
    tot = F.col("tot").cast("decimal(19,0)")
    squares = label.groupBy("c").agg(F.sum("k").alias("tot")).agg(F.sum(tot * tot).alias("squares"))
    row = within.crossJoin(squares).first()
    return near, two_m * (row["within"] or 0) - int(row["squares"] or 0)


def _moves(label: DataFrame, near: DataFrame, two_m: int) -> DataFrame:
    """v, c, new, gain of every node that gains by leaving its community c for the neighbouring one of greatest gain."""
    totals = label.groupBy("c").agg(F.sum("k").alias("tot"))
    option = label.join(near, "v").join(totals.select(F.col("c").alias("to"), F.col("tot").alias("tot_to")), "to")
    rest = F.col("tot_to") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(F.lit(0))
    option = option.withColumn("gain", F.col("w") - F.col("k") * rest / F.lit(float(two_m)))
    home = label.join(totals, "c").select("v", "k", "c", (-F.col("k") * (F.col("tot") - F.col("k")) / F.lit(float(two_m))).alias("alone"))
    best = option.groupBy("v").agg(F.max(F.when(F.col("to") == F.col("c"), F.col("gain"))).alias("stay"), F.min(F.struct((-F.round("gain", 9)).alias("g"), "to")).alias("top"))
    gain = -F.col("top.g") - F.coalesce("stay", "alone")
    return best.join(home, "v").select("v", "c", F.col("top.to").alias("new"), gain.alias("gain")).where((F.col("new") != F.col("c")) & (F.col("gain") > 1e-9 * F.greatest(F.lit(1), "k")))


def _apart(moves: DataFrame) -> DataFrame:
    """The moves that are best (then of the smallest node) of all that touch either of their communities; the best of all is one."""
    moves = moves.withColumn("rank", F.struct(-F.col("gain"), "v"))
    ends = moves.select(F.explode(F.array("c", "new")).alias("x"), "rank").groupBy("x").agg(F.min("rank").alias("first"))
    kept = moves
    for end in ("c", "new"):
        kept = kept.join(ends.select(F.col("x").alias(end), F.col("first").alias(f"{end}_first")), end).where(F.col("rank") == F.col(f"{end}_first"))
    return kept.select("v", "new")


def _moved(label: DataFrame, moves: DataFrame) -> DataFrame:
    return cut(label.join(moves.select("v", "new"), "v", "left").select("v", "k", F.coalesce("new", "c").alias("c")))


def attach(graph: EvidenceGraph) -> DataFrame:
    """Every node's metrics: id, degree, releaseCount, componentSize, component, pagerank, betweenness, core, community."""
    edges = cut(graph.topology())
    out = graph.nodes.select("id", F.size("releaseRefs").alias("releaseCount"))
    for part in (degree(edges), components(edges), pagerank(edges), betweenness(edges), core_numbers(edges), communities(edges)):
        out = out.join(part, "id", "left")
    return out.select(
        "id", F.coalesce("degree", F.lit(0)).cast("int").alias("degree"), "releaseCount", F.coalesce("size", F.lit(1)).cast("int").alias("componentSize"), "component",
        F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), F.coalesce("core", F.lit(0)).cast("int").alias("core"), F.col("community").cast("int").alias("community"),
    )
