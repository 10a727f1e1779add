"""Bounded queries over an evidence graph."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.graph import NODE_FAMILIES, NODE_KINDS, PEOPLE, EvidenceGraph, is_hub
from strandline.operators.metrics import both_ways, degree
from strandline.session import cut, cut_count

SEARCH_LIMIT = 12
VIEW_LIMIT = 80
OVERVIEW_RELEASES = 50
SELECTED_LIMIT = 24


class UnknownNode(LookupError):
    """An id that is no node, or an endpoint without a path."""


def search_text() -> Column:
    """All that a node is searched by, in lower case: label, summary, kind, facets and facts."""
    facets = F.flatten(F.transform(F.map_entries(F.coalesce("facets", F.create_map().cast("map<string,array<string>>"))), lambda e: F.concat(F.array(e["key"]), e["value"])))
    facts = F.flatten(F.transform(F.coalesce("facts", F.array().cast("array<struct<name:string,value:string,evidence:string,releaseRef:string>>")), lambda f: F.array(f["name"], f["value"])))
    return F.lower(F.concat_ws(" ", "label", "summary", "kind", facets, facts))


def label_score(terms: Sequence[str]) -> Column:
    """How many of the terms, repeats included, are a word of the label."""
    found = F.regexp_extract_all(F.lower("label"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    out = F.lit(0)
    for t in terms:
        out = out + F.array_contains(found, t).cast("int")
    return out


def search(graph: EvidenceGraph, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """id, label, kind, score, node_ord of the nodes that hold every term, best labels first."""
    terms = query.lower().split()
    nodes = graph.nodes.withColumn("_t", search_text())
    for t in terms:
        nodes = nodes.where(F.contains("_t", F.lit(t)))
    return nodes.select("id", "label", "kind", label_score(terms).alias("score"), "node_ord").orderBy(F.desc("score"), "node_ord").limit(limit)


def rank(graph: EvidenceGraph, values: DataFrame, metric: str, kinds: Sequence[str] = (), limit: int = SEARCH_LIMIT, include_hubs: bool = False) -> DataFrame:
    """id, label, kind, value, node_ord of the nodes with the greatest positive metric; authorities only on request."""
    nodes = graph.flagged().where(F.col("kind").isin(*kinds)) if kinds else graph.flagged()
    if not include_hubs:
        nodes = nodes.where(~F.col("authority"))
    found = nodes.join(values.select("id", F.col(metric).alias("value")), "id").where("value > 0")
    return found.select("id", "label", "kind", "value", "node_ord").orderBy(F.desc("value"), F.collate("label", "UNICODE"), "node_ord").limit(limit)


def focus(graph: EvidenceGraph, ids: DataFrame) -> EvidenceGraph:
    """The subgraph induced by ``ids`` (id): links with both ends in it, releases its nodes refer to."""
    ids = cut(ids.select("id").distinct())  # a table of known size: few ids are broadcast, however large the graph is
    nodes = graph.nodes.join(ids, "id", "left_semi")
    links = graph.links.join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi")
    refs = cut(nodes.select(F.explode("releaseRefs").alias("ref")).distinct())
    return EvidenceGraph(nodes, links, graph.releases.join(refs, "ref", "left_semi"))


def known(graph: EvidenceGraph, ids: Sequence[str]) -> list[str]:
    """The ids that are nodes, each once, in the order given. ``ids`` is a short list of an API call."""
    found = {r["id"] for r in graph.nodes.where(F.col("id").isin(*ids)).select("id").collect()} if ids else set()
    return [i for i in dict.fromkeys(ids) if i in found]


def _ids(graph: EvidenceGraph, ids: Sequence[str]) -> DataFrame:
    return graph.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")


@dataclass(frozen=True)
class Result:
    """What a query shows: ids in order (id, pos) and the subgraph they induce."""

    ids: DataFrame
    graph: EvidenceGraph
    truncated: bool = False
    people: DataFrame | None = None
    cluster: object = None

    def node_ids(self) -> list[str]:
        """The ids in order. Results are as long as their limit."""
        return [r["id"] for r in self.ids.orderBy("pos").collect()]


def result(graph: EvidenceGraph, ids: Sequence[str], **more) -> Result:
    """The known ids among those given, each once, and what they induce."""
    found = known(graph, ids)
    rows = graph.nodes.sparkSession.createDataFrame(list(zip(found, range(len(found)))), "id string, pos int")
    return Result(rows, focus(graph, rows), **more)


def filtered(graph: EvidenceGraph, kinds: Sequence[str], families: Sequence[str]) -> EvidenceGraph:
    """Nodes of the kinds, links of the families between them, all releases."""
    nodes = graph.nodes.where(F.col("kind").isin(*kinds))
    ids = nodes.select("id")
    links = graph.links.where(F.col("family").isin(*families)).join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi")
    return EvidenceGraph(nodes, links, graph.releases)


def overview(graph: EvidenceGraph, releases: int = OVERVIEW_RELEASES) -> EvidenceGraph:
    """The newest releases with what they mainly name, report and assert."""
    newest = cut(graph.releases.orderBy(F.desc("issueDate"), "release_ord").limit(releases).select(F.concat(F.lit("release:"), "ref").alias("id")))
    named = graph.links.where(F.col("kind").isin("primary_mention", "reports", "asserts")).join(newest, F.col("source") == F.col("id"), "left_semi").select(F.col("target").alias("id"))
    return focus(graph, newest.unionByName(named))


def incident(graph: EvidenceGraph, ids: Sequence[str]) -> DataFrame:
    """Links with an end in ``ids``."""
    return graph.links.where(F.col("source").isin(*ids) | F.col("target").isin(*ids))


def inspect(graph: EvidenceGraph, node: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The node, its links of every family, it and its neighbours in link order (id, pos), and its releases."""
    if not known(graph, [node]):
        raise UnknownNode(node)
    links = incident(graph, [node])
    other = F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source"))
    near = links.select(other.alias("id"), "link_ord").where(F.col("id") != node).groupBy("id").agg(F.min("link_ord").alias("pos"))
    near = near.unionByName(_ids(graph, [node]).withColumn("pos", F.lit(-1).cast("long")))
    own = graph.nodes.where(F.col("id") == node)
    refs = own.select(F.explode("releaseRefs").alias("ref")).distinct()
    return own, links, near, graph.releases.join(refs, "ref", "left_semi")


def hubs(graph: EvidenceGraph, ids: DataFrame | None = None) -> DataFrame:
    """id, degree, authority, hub of every node, or of those in ``ids`` (id) only."""
    nodes, counts = graph.flagged(), degree(graph.topology())
    if ids is not None:
        ways = both_ways(graph.topology()).join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        nodes, counts = nodes.join(ids, "id", "left_semi"), ways.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    flagged = nodes.join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return flagged.select("id", "degree", "authority", is_hub(F.col("degree"), F.col("authority")).alias("hub"))


def spread(graph: EvidenceGraph, seeds: Sequence[str], depth: int, limit: int, enter_hubs: bool) -> tuple[DataFrame, bool]:
    """(id, hop, at) reached from the known seeds in ``depth`` hops, and whether the cap refused any.

    Of the candidates of a hop those on the earliest links come first. With
    more seeds than ``limit`` there is no cap.
    """
    start = known(graph, seeds)
    seen = _ids(graph, start).select("id", F.lit(0).alias("hop"), F.lit(None).cast(graph.links.schema["link_ord"].dataType).alias("at"))
    ways = graph.adjacency()
    room = limit - len(start) if len(start) <= limit else None
    truncated = False
    for hop in range(1, depth + 1):
        front = seen.where(F.col("hop") == hop - 1).select(F.col("id").alias("src"))
        new = ways.join(front, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.min("link_ord").alias("at"))
        new = new.join(seen, "id", "left_anti")
        if not enter_hubs:
            new = cut(new)
            new = new.join(cut(hubs(graph, new.select("id")).where("hub").select("id")), "id", "left_anti")
        if room is not None:
            few = cut(new.orderBy("at", "id").limit(room + 1))
            n = few.count()
            truncated |= n > room
            new, room = few.orderBy("at", "id").limit(room), room - min(n, room)
        seen = cut(seen.unionByName(new.select("id", F.lit(hop).alias("hop"), "at")), seen)
    return seen, truncated


def _reached(graph: EvidenceGraph, seeds: Sequence[str], seen: DataFrame) -> DataFrame:
    """id, pos, hop of what was reached: seeds as given, then hop by hop in link order."""
    start = {i: n for n, i in enumerate(known(graph, seeds))}
    rows = [(r["id"], r["hop"], start.get(r["id"], r["at"])) for r in seen.collect()] if start else []  # at most the limit, or the seeds given
    rows.sort(key=lambda r: (r[1], r[2], r[0]))
    return seen.sparkSession.createDataFrame([(i, n, hop) for n, (i, hop, _) in enumerate(rows)], "id string, pos int, hop int")


def neighborhood(graph: EvidenceGraph, ids: Sequence[str], depth: int = 2, limit: int = VIEW_LIMIT, include_hubs: bool = False) -> Result:
    """All within ``depth`` hops (id, pos, hop), the people among them with their hops, and whether the cap cut it short."""
    seen, truncated = spread(graph, ids, depth, limit, include_hubs)
    found = _reached(graph, ids, seen)
    people = graph.nodes.where(F.col("kind").isin(*PEOPLE)).join(found, "id").select("node_ord", "id", "label", "kind", "hop")
    return Result(found, focus(graph, found), truncated, people)


def expand(graph: EvidenceGraph, ids: Sequence[str], limit: int = VIEW_LIMIT) -> Result:
    """One hop around the seeds, hubs entered."""
    seen, truncated = spread(graph, ids, 1, limit, True)
    found = _reached(graph, ids, seen)
    return Result(found, focus(graph, found), truncated)


def shortest(graph: EvidenceGraph, source: str, target: str) -> DataFrame:
    """step, id, link_ord (of the link that led there) of the shortest path; of several, the first in breadth-first order.

    A reached node carries its place in the queue as a text that sorts like
    the queue (place of its parent, then link order), so no level is numbered,
    and the node it was reached from. The search ends with the target or when
    nothing new is reached; then the path is read back level by level.
    """
    ends = [source] if source == target else [source, target]
    if len(known(graph, ends)) < len(ends):
        raise UnknownNode("Unknown path endpoint")
    spark = graph.nodes.sparkSession
    ways = cut(graph.adjacency())
    front = spark.createDataFrame([(source, "", None, None)], "id string, place string, parent string, link_ord bigint")
    seen, levels, hit = front.select("id"), [front], int(source == target)
    while not hit:
        new = ways.withColumnRenamed("link_ord", "_o").join(front.select(F.col("id").alias("src"), "place"), "src")
        new = new.select(F.col("dst").alias("id"), F.concat("place", F.lpad(F.col("_o").cast("string"), 16, "0")).alias("place"), F.col("src").alias("parent"), F.col("_o").alias("link_ord"))
        new = new.join(seen, "id", "left_anti").groupBy("id").agg(F.min(F.struct("place", "parent", "link_ord")).alias("b")).select("id", "b.*")
        front, reached = cut_count(new)
        if not reached:
            raise UnknownNode("No path found")
        levels.append(front)
        seen = cut(seen.unionByName(front.select("id")), seen)
        hit = front.where(F.col("id") == target).limit(1).count()
    steps, at = [], target
    for n in range(len(levels) - 1, -1, -1):
        row = levels[n].where(F.col("id") == at).select("parent", "link_ord").first()
        steps.append((n, at, row["link_ord"]))
        at = row["parent"]
    return spark.createDataFrame(steps[::-1], "step int, id string, link_ord bigint")


def trace(graph: EvidenceGraph, source: str, target: str) -> Result:
    """The shortest path: its nodes in order and the links that make it up."""
    path = shortest(graph, source, target)
    ids = path.select("id", F.col("step").alias("pos"))
    induced = focus(graph, ids)
    return Result(ids, EvidenceGraph(induced.nodes, graph.links.join(F.broadcast(path.select("link_ord").where("link_ord is not null")), "link_ord", "left_semi"), induced.releases))


def cluster(graph: EvidenceGraph, metrics: DataFrame, seed: str, column: str, limit: int = VIEW_LIMIT) -> Result:
    """The seed, then members of its cluster by pagerank and label, up to ``limit``; a node of no cluster alone."""
    if not known(graph, [seed]):
        raise UnknownNode(seed)
    own = metrics.where(F.col("id") == seed).select(column).first()
    if own is None or own[0] is None:
        return result(graph, [seed])
    members = metrics.where(F.col(column) == F.lit(own[0])).join(graph.nodes.select("id", "label", "node_ord"), "id")
    order = (F.desc("pagerank"), F.collate("label", "UNICODE"), F.col("node_ord"))
    top = [r["id"] for r in members.orderBy((F.col("id") != seed), *order).select("id").limit(limit + 1).collect()]
    return result(graph, top[:limit], truncated=len(top) > limit, cluster=own[0])


def view(graph: EvidenceGraph, ids: Sequence[str], selected: Sequence[str], mode: str | None = None) -> tuple[Result, list[str]]:
    """What to show of the given nodes and the selected ones, and which are selected; with neighbours in mode ego (the default for one seed)."""
    chosen = known(graph, selected)[:SELECTED_LIMIT]
    seeds = list(dict.fromkeys([*chosen, *known(graph, ids)]))
    shown = expand(graph, seeds).node_ids() if (mode or ("ego" if len(seeds) == 1 else "exact")) == "ego" else seeds
    return result(graph, shown[:VIEW_LIMIT]), chosen


def kinds_of(families: Sequence[str]) -> list[str]:
    """The node kinds of the families, in their usual order."""
    return [k for k in NODE_KINDS if NODE_FAMILIES.get(k, "entity") in families]


def metric_facts(metrics: DataFrame) -> DataFrame:
    """id, name, value: a node's positive metrics, and its component and community where it has them."""
    names = ("degree", "releaseCount", "componentSize", "pagerank", "betweenness", "core")
    pairs = [F.struct(F.lit(n).alias("name"), F.when(F.col(n) > 0, F.col(n).cast("string")).alias("value")) for n in names]
    pairs += [F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in ("component", "community")]
    return metrics.select("id", F.inline(F.array(*pairs))).where("value is not null")


def histogram(df: DataFrame, column: str) -> DataFrame:
    """value, n."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def summary(graph: EvidenceGraph, parts: DataFrame) -> DataFrame:
    """first_day, last_day, nodes, links, releases, components, outside, largest. ``parts``: components of the topology."""
    days = graph.releases.agg(F.min(F.substring("issueDate", 1, 10)).alias("first_day"), F.max(F.substring("issueDate", 1, 10)).alias("last_day"), F.count(F.lit(1)).alias("releases"))
    nodes = graph.nodes.agg(F.count(F.lit(1)).alias("nodes"))
    links = graph.links.agg(F.count(F.lit(1)).alias("links"))
    comp = parts.agg(F.countDistinct("component").alias("components"), F.count(F.lit(1)).alias("_in"), F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("largest"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    out = one(days).join(one(nodes), "_k").join(one(links), "_k").join(one(comp), "_k")
    return out.select("first_day", "last_day", "nodes", "links", "releases", "components", (F.col("nodes") - F.col("_in")).alias("outside"), "largest")
