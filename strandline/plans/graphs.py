"""Registered graph queries on the fixture graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.graph import EvidenceGraph, node_family
from strandline.operators import metrics as M
from strandline.operators import query as Q
from strandline.plans import apart
from strandline.plans.fixture import LARGE, SMALL, PlacedGraph, fixture_graph, placed_graph
from strandline.session import cut

PARTIES = ("person", "organization", "instrument")


def _edges(g: EvidenceGraph) -> DataFrame:
    return cut(g.topology())


def _first(g: EvidenceGraph, kind: str) -> str:
    """The node of a kind that comes first in the graph."""
    return g.nodes.where(F.col("kind") == kind).orderBy("node_ord").first()["id"]


def _ranked(metric: str, values: Callable[[EvidenceGraph], DataFrame], digits: int | None = None):
    def run(g: EvidenceGraph) -> DataFrame:
        v = values(g)
        if digits is not None:
            v = v.withColumn(metric, F.round(metric, digits))
        out = g.dense(Q.rank(g, v, metric, PARTIES), "node_ord")
        return out.withColumn("value", F.col("value").cast("double"))

    return run


def _subgraph(sub: EvidenceGraph, of: EvidenceGraph | None = None) -> DataFrame:
    """The parts of a subgraph; link ordinals are those of the graph it is ``of``."""
    nodes = sub.nodes.select(F.lit("node").alias("part"), "id")
    links = sub.links.select("link_ord")
    links = (links if of is None else of.dense(links, "link_ord")).select(F.lit("link").alias("part"), F.col("link_ord").cast("string").alias("id"))
    return nodes.unionByName(links).unionByName(sub.releases.select(F.lit("release").alias("part"), F.col("ref").alias("id")))


def _inspect(g: EvidenceGraph) -> DataFrame:
    own, links, near, releases = Q.inspect(g, _first(g, "organization"))
    out = own.select(F.lit("node").alias("part"), "id").unionByName(links.select(F.lit("link"), F.col("link_ord").cast("string")).toDF("part", "id"))
    return out.unionByName(near.select(F.lit("near").alias("part"), "id")).unionByName(releases.select(F.lit("release").alias("part"), F.col("ref").alias("id")))


def _reach(depth: int, limit: int = 10**6, hubs: bool = False):
    def run(g: EvidenceGraph) -> DataFrame:
        return Q.spread(g, [_first(g, "person")], depth, limit, hubs)[0].select("id", "hop")

    return run


def _shown(r: Q.Result, of: EvidenceGraph | None = None) -> DataFrame:
    """All parts of a result: ids with their place, links, releases, and whether it was cut short."""
    ids = r.ids.select(F.lit("node").alias("part"), "id", F.col("pos").cast("long").alias("pos"))
    links = r.graph.links.select("link_ord")
    links = (links if of is None else of.dense(links, "link_ord")).select(F.lit("link").alias("part"), F.col("link_ord").cast("string").alias("id"), F.lit(-1).cast("long").alias("pos"))
    releases = r.graph.releases.select(F.lit("release").alias("part"), F.col("ref").alias("id"), F.lit(-1).cast("long").alias("pos"))
    return ids.unionByName(links).unionByName(releases).withColumn("truncated", F.lit(r.truncated))


def _neighborhood(g: EvidenceGraph) -> DataFrame:
    """With the default depth and a cap that bites."""
    seeds = [r["id"] for r in g.nodes.where("kind = 'person'").orderBy("node_ord").limit(5).collect()]
    return _shown(Q.neighborhood(g, seeds, 2, 12), g)


def _people(g: EvidenceGraph) -> DataFrame:
    seeds = [r["id"] for r in g.nodes.where("kind = 'organization'").orderBy("node_ord").limit(3).collect()]
    return Q.neighborhood(g, seeds, 3, 80, True).people.select("id", "label", F.col("hop").cast("long").alias("hop"))


def _expand(g: EvidenceGraph) -> DataFrame:
    found = Q.expand(g, [_first(g, "organization")])
    return found.ids.select("id", "hop")


def _farthest(g: EvidenceGraph) -> str:
    return Q.spread(g, [_first(g, "person")], 6, 10**6, True)[0].orderBy(F.desc("hop"), F.desc("id")).first()["id"]


def _trace(g: EvidenceGraph) -> DataFrame:
    """The path itself, step by step."""
    return Q.shortest(g, _first(g, "person"), _farthest(g)).select(F.col("step").cast("long").alias("step"), "id", F.coalesce("link_ord", F.lit(-1)).alias("link_ord"))


def _component_of(g: EvidenceGraph) -> DataFrame:
    """Seed first, then by pagerank and label, with the default cap."""
    edges = _edges(g)
    table = M.components(edges).join(M.pagerank(edges).withColumn("pagerank", F.round("pagerank", 7)), "id")
    return _shown(Q.cluster(g, table, _first(g, "person"), "component"))


def _community(g: EvidenceGraph) -> DataFrame:
    edges = _edges(g)
    table = M.communities(edges).join(M.pagerank(edges).withColumn("pagerank", F.round("pagerank", 7)), "id")
    return _shown(Q.cluster(g, table, _first(g, "person"), "community"))


def _view(g: EvidenceGraph) -> DataFrame:
    shown, _ = Q.view(g, [], [_first(g, "person")])
    return _shown(shown)


def _attached(g: EvidenceGraph) -> DataFrame:
    """All metrics of all nodes, but for the communities, as names and values."""
    return Q.metric_facts(M.attach(g).drop("community").withColumns({c: F.round(c, 7) for c in ("pagerank", "betweenness")}).withColumn("community", F.lit(None).cast("int"))).where("name not in ('pagerank', 'betweenness')")


def _flags(g: EvidenceGraph) -> DataFrame:
    return g.flagged().select("id", "authority", node_family(F.col("kind")).alias("node_family"))


SMALL_QUERIES: dict[str, Callable[[EvidenceGraph], DataFrame]] = {
    "topology_edges": lambda g: g.topology(),
    "degree": lambda g: M.degree(g.topology()),
    "rank_degree": _ranked("degree", lambda g: g.ends(PARTIES).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))),
    "rank_release_count": _ranked("n", lambda g: g.nodes.select("id", F.size("releaseRefs").alias("n"))),
    "rank_pagerank": _ranked("pagerank", lambda g: M.pagerank(_edges(g)), 7),
    "rank_betweenness": _ranked("betweenness", lambda g: M.betweenness(_edges(g)), 7),
    "rank_core": _ranked("core", lambda g: M.core_numbers(_edges(g))),
    "search_terms": lambda g: g.dense(Q.search(g, "supplier 00"), "node_ord"),
    "inspect_node": _inspect,
    "focus_subgraph": lambda g: _subgraph(Q.focus(g, g.nodes.where(F.col("kind").isin("person", "risk", "release")).select("id"))),
    "filter_subgraph": lambda g: _subgraph(Q.filtered(g, PARTIES, ("participation", "relationship"))),
    "overview_graph": lambda g: _subgraph(Q.overview(g), g),
    "expand_nodes": _expand,
    "neighborhood_d1": _reach(1),
    "neighborhood_d2": _reach(2),
    "neighborhood_d3": _reach(3),
    "neighborhood_capped": lambda g: Q.spread(g, [r["id"] for r in g.nodes.where("kind = 'person'").orderBy("node_ord").limit(3).collect()], 1, 6, False)[0].select("id", "hop"),
    "neighborhood_people": _people,
    "neighborhood_result": _neighborhood,
    "view_ego": _view,
    "metric_facts": _attached,
    "trace_path": _trace,
    "components": lambda g: M.components(_edges(g)),
    "component_graph": _component_of,
    "pagerank": lambda g: M.pagerank(_edges(g)).withColumn("pagerank", F.round("pagerank", 7)),
    "betweenness": lambda g: M.betweenness(_edges(g)).withColumn("betweenness", F.round("betweenness", 7)),
    "core_number": lambda g: M.core_numbers(_edges(g)),
    "louvain": lambda g: M.communities(_edges(g)),
    "community_graph": _community,
    "graph_summary": lambda g: Q.summary(g, M.components(_edges(g))),
    "kind_counts": lambda g: Q.histogram(g.nodes, "kind"),
    "family_counts": lambda g: Q.histogram(g.links, "family"),
}


def _rank_degree_all(g: PlacedGraph) -> DataFrame:
    """Only parties that can be among the first are gathered as nodes."""
    near, degrees = g.leading(Q.SEARCH_LIMIT)
    return _ranked("degree", lambda _: degrees)(near)


#: Queries of all lines that are worked out another way than on the small graph, with the same rows.
ALL_QUERIES: dict[str, Callable[[PlacedGraph], DataFrame]] = {
    "rank_degree": _rank_degree_all,
    "components": apart.components,
    "core_number": apart.core_numbers,
    "pagerank": lambda g: apart.pagerank(g).withColumn("pagerank", F.round("pagerank", 7)),
}


def queries() -> dict:
    def on(size, run, residents=False):
        return lambda spark, sf_dir: run(fixture_graph(spark, sf_dir, size, residents))

    out = {name: on(SMALL, run) for name, run in SMALL_QUERIES.items()}
    for name in ("degree", "rank_degree", "components", "pagerank", "core_number", "search_terms", "neighborhood_result", "overview_graph"):
        out[f"{name}_all"] = lambda spark, sf_dir, run=ALL_QUERIES.get(name, SMALL_QUERIES[name]): run(placed_graph(spark, sf_dir))
    out["authority_flags"] = on(LARGE, _flags)
    out["hub_flags"] = on(LARGE, Q.hubs, True)
    out["components_large"] = on(LARGE, lambda g: M.components(_edges(g)))
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parties of greatest degree."""
    return queries()["rank_degree"](spark, sf_dir)
