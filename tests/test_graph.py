import itertools
import random

import pytest

from strandline.api import Context, GraphSession, InvalidQuery, compacted, described_context, latest_view, normalized_context
from strandline.graph import FACETS, FACTS, EvidenceGraph
from strandline.operators import metrics as M
from strandline.operators import query as Q
from strandline.operators.order import ordered
from strandline.operators.skew import hot_keys
from strandline.plans import fixture, graphs
from strandline.sources.graph_io import InvalidGraph, checked, graph_json, is_current, read_graph, write_graph


def build(spark, edges, subjects=(), authorities=(), kinds=None):
    ids = sorted({x for e in edges for x in e[:2]})
    nodes = [(i, n, f"Label {n}", (kinds or {}).get(n, "person"), "", ["1PR1"], {"involvement": ["authority"] if n in authorities else ["subject"]}, []) for i, n in enumerate(ids)]
    links = [(i, e[0], e[1], "knows", e[2] if len(e) > 2 else "relationship", "", "1PR1", {}, []) for i, e in enumerate(edges)]
    return EvidenceGraph(
        spark.createDataFrame(nodes, f"node_ord long, id string, label string, kind string, summary string, releaseRefs array<string>, facets {FACETS}, facts {FACTS}"),
        spark.createDataFrame(links, f"link_ord long, source string, target string, kind string, family string, evidence string, releaseRef string, facets {FACETS}, facts {FACTS}"),
        spark.createDataFrame([(0, "1PR1", "t", "2020-01-01", "https://example.org/1")], "release_ord long, ref string, title string, issueDate string, url string"),
    )


PATH = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), ("e", "f"), ("c", "c"), ("a", "z", "evidence")]


def test_topology_and_components(spark):
    g = build(spark, PATH, authorities=("f",))
    assert {(r["a"], r["b"]) for r in g.topology().collect()} == {("a", "b"), ("b", "c"), ("c", "d")}
    assert {(r["id"], r["component"], r["size"]) for r in M.components(g.topology()).collect()} == {(x, "a", 4) for x in "abcd"}


def test_core_and_betweenness_both_ways(spark):
    clique = list(itertools.combinations("abcd", 2)) + [("d", "e"), ("e", "f")]
    edges = build(spark, clique).topology()
    assert {r["id"]: r["core"] for r in M.core_numbers(edges).collect()} == {"a": 3, "b": 3, "c": 3, "d": 3, "e": 1, "f": 1}
    one = {r["id"]: round(r["betweenness"], 9) for r in M.betweenness(edges).collect()}
    two = {r["id"]: round(r["betweenness"], 9) for r in M.betweenness(edges, limit=0).collect()}
    assert one == two and one["d"] == pytest.approx(12 / 20) and one["a"] == 0


def modularity(edges, of):
    tot, within = {}, 0
    for a, b in edges:
        for x in (a, b):
            tot[of[x]] = tot.get(of[x], 0) + 1
        within += of[a] == of[b]
    return within / len(edges) - sum(t * t for t in tot.values()) / (2 * len(edges)) ** 2


def test_communities_leave_no_gain(spark):
    """A long chain needs many levels; cliques in a ring, many rounds."""
    chain = [(f"p{i:03}", f"p{i + 1:03}") for i in range(80)]
    ring = [(f"q{k:02}{x}", f"q{k:02}{y}") for k in range(5) for x, y in itertools.combinations("abcd", 2)] + [(f"q{k:02}a", f"q{(k + 1) % 5:02}b") for k in range(5)]
    edges = chain + ring
    df = spark.createDataFrame(edges, "a string, b string")
    of = {r["id"]: r["community"] for r in M.communities(df.repartition(1)).collect()}
    assert of == {r["id"]: r["community"] for r in M.communities(df.repartition(7)).collect()}
    assert len({of[x] for x in of if x[0] == "p"} & {of[x] for x in of if x[0] == "q"}) == 0
    assert all(len({of[f"q{k:02}{x}"] for x in "abcd"}) == 1 for k in range(5))
    assert modularity(edges, of) > modularity(edges, {x: x for x in of})
    near = {(of[a], of[b]) for a, b in edges if of[a] != of[b]}
    for a, b in near:  # no community gains by joining another
        assert modularity(edges, {x: a if c == b else c for x, c in of.items()}) <= modularity(edges, of) + 1e-12
    firsts = [min(x for x in of if of[x] == c) for c in range(len(set(of.values())))]
    assert firsts == sorted(firsts)


def test_trace_prefers_first_in_breadth_first_order(spark):
    g = build(spark, [("a", "x"), ("a", "y"), ("y", "t"), ("x", "t")])
    path = Q.trace(g, "a", "t")
    assert path.node_ids() == ["a", "x", "t"] and sorted(r["link_ord"] for r in path.graph.links.collect()) == [0, 3]
    assert [(r["step"], r["id"], r["link_ord"]) for r in Q.shortest(g, "t", "a").orderBy("step").collect()] == [(0, "t", None), (1, "y", 2), (2, "a", 1)]
    assert Q.trace(g, "a", "a").node_ids() == ["a"]
    with pytest.raises(Q.UnknownNode, match="endpoint"):
        Q.trace(g, "a", "nobody")
    with pytest.raises(Q.UnknownNode, match="No path"):
        Q.trace(build(spark, PATH), "a", "e")


def test_neighborhood_caps_and_hubs(spark):
    g = build(spark, [("a", "b"), ("a", "c"), ("c", "d"), ("a", "h"), ("h", "x")], authorities=("h",))
    seen, cut = Q.spread(g, ["a"], 2, 3, False)
    assert {(r["id"], r["hop"]) for r in seen.collect()} == {("a", 0), ("b", 1), ("c", 1)} and cut
    seen, cut = Q.spread(g, ["a"], 2, 10, False)
    assert {r["id"] for r in seen.collect()} == set("abcd") and not cut
    assert {r["id"] for r in Q.spread(g, ["a", "?"], 2, 10, True)[0].collect()} == set("abcdhx")


def test_results_clusters_and_views(spark):
    g = build(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("a", "z", "evidence")], kinds={"d": "fund"})
    hood = Q.neighborhood(g, ["c", "a", "c", "?"], 1, 80)
    assert hood.node_ids() == ["c", "a", "b", "d"] and not hood.truncated and hood.graph.links.count() == 3
    assert {(r["id"], r["hop"]) for r in hood.people.collect()} == {("c", 0), ("a", 0), ("b", 1)}
    edges = g.topology()
    table = M.components(edges).join(M.pagerank(edges), "id")
    own = Q.cluster(g, table, "d", "component", 3)
    assert own.node_ids() == ["d", "b", "c"] and own.truncated and own.cluster == "a" and own.graph.links.count() == 2
    alone = Q.cluster(g, table, "z", "component")
    assert alone.node_ids() == ["z"] and alone.cluster is None and not alone.truncated
    with pytest.raises(Q.UnknownNode):
        Q.cluster(g, table, "?", "component")
    shown, chosen = Q.view(g, [], ["b", "!"])
    assert shown.node_ids() == ["b", "a", "c"] and chosen == ["b"]
    assert Q.view(g, ["x"], ["b"])[0].node_ids() == ["b", "x"] and Q.view(g, ["x"], ["b"], "ego")[0].node_ids() == ["b", "x", "a", "c", "y"]
    assert Q.kinds_of(["risk", "source"]) == ["release", "risk"] and len(Q.kinds_of(["entity"])) == 6


def test_metrics_of_all_nodes(spark):
    g = build(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("a", "z", "evidence")])
    attached = M.attach(g)
    table = spark.createDataFrame(attached.collect(), attached.schema)
    rows = {r["id"]: r for r in table.collect()}
    assert (rows["c"]["degree"], rows["c"]["core"], rows["c"]["componentSize"], rows["c"]["component"]) == (3, 2, 4, "a")
    assert (rows["z"]["degree"], rows["z"]["componentSize"], rows["z"]["component"], rows["z"]["community"], rows["z"]["pagerank"]) == (0, 1, None, None, 0.0)
    facts = {(r["id"], r["name"]) for r in Q.metric_facts(table).collect()}
    assert ("z", "componentSize") in facts and ("z", "degree") not in facts and ("a", "community") in facts
    s = GraphSession(g, table)
    assert s.summary()["counts"] | {"nodeKinds": 0, "edgeFamilies": 0} == {"nodes": 5, "links": 5, "releases": 1, "nodeKinds": 0, "edgeFamilies": 0, "components": 1, "outsideTopology": 1, "largestComponent": 4}
    assert s.component("d").cluster == "a" and s.show(["a"], ["z"]) == {"view": {"mode": "focus", "nodeIds": ["z", "a"], "selectedNodeIds": ["z"]}} and "trace" in s.discover()["endpoints"]


def test_components_of_chains_and_rings(spark):
    rng = random.Random(2)
    ids = [f"n{i:03}" for i in range(120)]
    rng.shuffle(ids)
    edges = list(zip(ids[:60], ids[1:60])) + list(zip(ids[60:100], ids[61:100] + [ids[60]])) + [(ids[100], x) for x in ids[101:]]
    want = {x: min(part) for part in (ids[:60], ids[60:100], ids[100:]) for x in part}
    got = M.components(spark.createDataFrame(edges + [(b, a) for a, b in edges[:9]], "a string, b string")).collect()
    assert {r["id"]: r["component"] for r in got} == want and {r["size"] for r in got} == {60, 40, 20}
    assert M.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_metrics_with_a_hot_node(spark, monkeypatch):
    """A node on a third of all edges is split off the joins; nothing changes by it."""
    edges = spark.createDataFrame([("h", f"x{i:02}") for i in range(30)] + [(f"x{i:02}", f"x{i + 1:02}") for i in range(0, 30, 2)] + [("y", "z")], "a string, b string")
    read = lambda: [sorted(map(tuple, f(edges).collect())) for f in (M.components, M.core_numbers, M.communities)] + [{r["id"]: round(r["pagerank"], 9) for r in M.pagerank(edges, 5).collect()}]
    plain = read()
    monkeypatch.setattr(M, "HOT_ROWS", 0)
    monkeypatch.setattr(M, "hot_keys", lambda df, on: hot_keys(df, on, floor=5))
    assert hot_keys(M.both_ways(edges), ["dst"], floor=5) == [("h",)] and read() == plain


def test_interface_bounds_and_context(spark):
    g = build(spark, PATH)
    s = GraphSession(g, M.degree(g.topology()))
    for bad in (lambda: s.search(""), lambda: s.search("x", 51), lambda: s.neighborhood(["a"], depth=4), lambda: s.rank("size"), lambda: s.expand([])):
        with pytest.raises(InvalidQuery):
            bad()
    assert [r["id"] for r in s.search("label a").collect()][:2] == ["a", "b"]
    c = normalized_context(g, Context(["a", "?", "a"], "focus", ["b", "!"], ("a", "b", "knows")))
    assert (c.selected, c.shown, c.link) == (["a"], ["b"], ("a", "b", "knows"))
    assert normalized_context(g, Context(link=("a", "b", "hates"))).link is None
    for bad in (lambda: Context(["a"] * 25), lambda: Context(shown=["a"] * 81), lambda: Context(mode="some"), lambda: Context(kinds=["odd"])):
        with pytest.raises(InvalidQuery):
            bad()
    said = described_context(g, Context(["a", "?"], "focus", ["b"], ("a", "b", "knows"), kinds=["person"], families=[]))
    assert "Label a [a]" in said and "[a] -knows-> [b]" in said and "nodes b" in said and "shown: person" in said and "shown: none" in said and "?" not in said


def test_chat_helpers():
    said, call = {"type": "text", "text": "hello", "state": "done"}, {"type": "tool-rank"}
    history = [{"id": "1", "role": "user", "parts": [said, call]}, {"id": "2", "role": "assistant", "parts": [call]}, {"id": "3", "role": "user", "parts": [{"type": "text"}]}, {"id": "4", "role": "assistant", "parts": [call]}]
    short = compacted(history)
    assert short == [{"id": "1", "role": "user", "parts": [{"type": "text", "text": "hello"}]}, {"id": "3", "role": "user", "parts": [{"type": "text", "text": ""}]}, history[3]] and compacted([]) == []
    show = lambda nodes, selected=(), state="output-available", mode="focus", **more: {"type": "tool-show", "state": state, "output": {"view": {"mode": mode, "nodeIds": nodes, "selectedNodeIds": list(selected)}}, **more}
    message = {"id": "m", "role": "assistant", "parts": [show(["x"], toolCallId="t"), show(["y"], ["x"]), show(["z"], state="input-available"), show([]), show(["q"], mode="all"), show([1]), said]}
    assert latest_view(message) == ("m:1", {"mode": "focus", "nodeIds": ["y"], "selectedNodeIds": ["x"]})
    assert latest_view({**message, "parts": message["parts"][:1]}) == ("t", {"mode": "focus", "nodeIds": ["x"], "selectedNodeIds": []})
    assert latest_view({**message, "role": "user"}) is None and latest_view({"id": "m", "role": "assistant"}) is None


def test_graph_document(spark, tmp_path):
    g = build(spark, PATH)
    text = graph_json(g)
    write_graph(tmp_path / "x" / "graph.json", text)
    assert is_current(tmp_path / "x" / "graph.json", text) and not is_current(tmp_path / "none", text)
    assert graph_json(read_graph(spark, str(tmp_path / "x" / "graph.json"))) == text
    with pytest.raises(InvalidGraph):
        checked(EvidenceGraph(g.nodes.union(g.nodes), g.links, g.releases))
    with pytest.raises(InvalidGraph):
        checked(EvidenceGraph(g.nodes.where("id <> 'a'"), g.links, g.releases))


def test_ends_and_hubs_of_some_nodes_only(spark):
    g = build(spark, [("a", "b"), ("a", "c"), ("c", "d"), ("a", "h")], authorities=("h",), kinds={"b": "risk", "c": "fund"})
    assert sorted(map(tuple, g.ends(("person", "fund")).collect())) == [("a", "b"), ("a", "c"), ("c", "a"), ("c", "d"), ("d", "c")]
    some = spark.createDataFrame([("a",), ("h",)], "id string")
    assert sorted(map(tuple, Q.hubs(g, some).collect())) == [("a", 2, False, False), ("h", 0, True, True)]


@pytest.fixture(scope="module")
def order_tables(spark, tmp_path_factory):
    """Order tables with repeated lines, suppliers and parts that come again, some in more than ten orders, and names for some."""
    at, rng = tmp_path_factory.mktemp("orders"), random.Random(5)
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    items = [(o, rng.randint(1, 4), rng.choice((1, 2, 10, 10 + o)), rng.choice((1, 2, 3, 100 + o))) for o in range(1, 41) for _ in range(4)]
    write("lineitem", items + items[:9], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long")
    write("orders", [(o, 1 + o % 6, f"2020-01-{1 + o % 9:02d}", "1-URGENT") for o in range(1, 41)], "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string")
    write("supplier", [(k, f"Supplier 00{k}") for k in (1, 2, 10)], "s_suppkey long, s_name string")
    write("part", [(k, f"part {k}") for k in (1, 2)], "p_partkey long, p_name string")
    write("customer", [(k, f"Customer {k}") for k in range(1, 6)], "c_custkey long, c_name string")
    return str(at)


def test_graph_by_places_equals_the_graph_by_ordinals(spark, order_tables):
    whole, placed = fixture.fixture_graph(spark, order_tables, fixture.ALL), fixture.placed_graph(spark, order_tables)
    rows = lambda df, *columns: sorted(map(tuple, df.select(*columns).collect()), key=repr)
    columns = ("node_ord", "id", "label", "kind", "summary", "releaseRefs")
    assert rows(placed.dense(placed.nodes, "node_ord"), *columns) == rows(whole.nodes, *columns)
    columns = ("link_ord", "source", "target", "kind", "family", "evidence", "releaseRef")
    assert rows(placed.dense(placed.links, "link_ord"), *columns) == rows(whole.links, *columns)
    assert rows(placed.flagged(), "id", "authority") == rows(whole.flagged(), "id", "authority")
    assert rows(placed.topology(), "a", "b") == rows(whole.topology(), "a", "b")
    assert rows(placed.releases, "ref", "title", "issueDate", "url") == rows(whole.releases, "ref", "title", "issueDate", "url")


def test_search_of_all_lines_puts_few_nodes_in_order(spark, order_tables, monkeypatch):
    put, every = [], fixture.placed_graph(spark, order_tables).nodes.count()
    monkeypatch.setattr(fixture, "ordered", lambda df, *by: put.append(df.count()) or ordered(df, *by))
    found = graphs.queries()["search_terms_all"](spark, order_tables).collect()
    assert [r["id"] for r in found] and put and max(put) < every / 2


@pytest.fixture(scope="module")
def mixed_tables(spark, tmp_path_factory):
    """Order tables where most customers meet authorities only, some a supplier of few orders; orders without a customer; orders of one line and of many."""
    at, rng = tmp_path_factory.mktemp("mixed"), random.Random(7)
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    items = [(o, n, 5 + o if o % 12 == 0 and n == 1 else rng.choice((1, 2, 10)), rng.choice((1, 2, 300 + o))) for o in range(1, 61) for n in range(1, 2 + o % 4)]
    write("lineitem", items + items[:9], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long")
    write("orders", [(o, None if o % 10 in (1, 2) else o % 9, f"2020-01-{1 + o % 9:02d}", "1-URGENT") for o in range(1, 61)], "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string")
    write("supplier", [(k, f"Supplier 00{k}") for k in (1, 2, 10)], "s_suppkey long, s_name string")
    write("part", [(k, f"part {k}") for k in (1, 2)], "p_partkey long, p_name string")
    write("customer", [(k, f"Customer {k}") for k in range(1, 6)], "c_custkey long, c_name string")
    return str(at)


def all_lines(spark, monkeypatch, tables, name, metric):
    """Rows of a query of all lines and of the rounds on the whole edge list; most edges the rounds were given; all edges."""
    edges = fixture.placed_graph(spark, tables).topology()
    want = sorted(map(tuple, metric(edges).collect()))
    given, rounds = [], getattr(M, metric.__name__)
    monkeypatch.setattr(M, metric.__name__, lambda edges, *args, **more: given.append(edges.count()) or rounds(edges, *args, **more))
    got = graphs.queries()[name](spark, tables)
    return sorted(map(tuple, got.collect())), want, max(given, default=0), edges.count()


@pytest.mark.parametrize("tables", ["order_tables", "mixed_tables"])
def test_components_of_all_lines_join_few_edges(spark, monkeypatch, request, tables):
    got, want, given, every = all_lines(spark, monkeypatch, request.getfixturevalue(tables), "components_all", M.components)
    assert got == want and (given < every / 2 or tables == "order_tables")


def test_core_numbers_of_all_lines_join_few_edges(spark, monkeypatch, mixed_tables):
    got, want, given, every = all_lines(spark, monkeypatch, mixed_tables, "core_number_all", M.core_numbers)
    assert got == want and given < every / 2


def test_pagerank_of_all_lines_joins_few_edges(spark, monkeypatch, mixed_tables):
    got, want, given, every = all_lines(spark, monkeypatch, mixed_tables, "pagerank_all", M.pagerank)
    assert got == [(i, round(x, 7)) for i, x in want] and given < every / 2


def test_rank_of_all_lines_equals_the_rank_of_all_nodes(spark, order_tables):
    at = order_tables
    g = fixture.placed_graph(spark, at)
    degrees = g.ends(graphs.PARTIES).groupBy("src").count()
    assert sorted(map(tuple, g.degrees().selectExpr("concat(substring(kind, 1, 1), key)", "degree").collect())) == sorted(map(tuple, degrees.collect()))
    want = Q.rank(g, degrees.toDF("id", "degree"), "degree", graphs.PARTIES)
    got = graphs.queries()["rank_degree_all"](spark, at).collect()
    assert sorted((r["id"], r["label"], r["value"]) for r in got) == sorted((r["id"], r["label"], float(r["value"])) for r in want.collect())


def test_rank_of_all_lines_gathers_few_nodes(spark, monkeypatch, tmp_path):
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    write("lineitem", [(o, n, 10 * o, o) for o in range(1, 41) for n in range(1, 5 if o <= 12 else 2)], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long")
    write("orders", [(o, o, "2020-01-02", "1-URGENT") for o in range(1, 41)], "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string")
    for name, key in (("supplier", "s_supp"), ("part", "p_part"), ("customer", "c_cust")):
        write(name, [(1, name)], f"{key}key long, {name[0]}_name string")
    given, rank = [], Q.rank
    monkeypatch.setattr(Q, "rank", lambda g, *args: given.append(g.nodes.where("kind = 'person'").count()) or rank(g, *args))
    got = graphs.queries()["rank_degree_all"](spark, str(tmp_path)).collect()
    assert {(r["id"], r["value"]) for r in got} == {(f"c{o}", 4.0) for o in range(1, 13)} and given == [12]


def test_structure_in_one_task_equals_the_rounds(spark, monkeypatch):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)} | {(90, 91), (91, 92)} | set(itertools.combinations(range(70, 76), 2))
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "a string, b string")
    read = lambda df: sorted((*r[:5], round(r[5], 12)) for r in df.collect())
    want = read(M.structure(edges, limit=0))
    for name in ("components", "core_numbers", "pagerank"):
        monkeypatch.setattr(M, name, None)
    assert read(M.structure(edges)) == want and M.structure(edges.limit(0)).count() == 0
