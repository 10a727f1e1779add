"""DuckDB SQL of the graph queries."""

from __future__ import annotations

from strandline.plans.fixture import ALL, LARGE, SMALL, Size


def base(size: Size, residents: bool = False) -> str:
    """Common tables h, node (with ord, authority), link, rel, edge (a < b) and way (both directions of non-evidence links)."""
    extra_nodes = extra_links = ""
    if residents:
        extra_nodes = """
    UNION ALL SELECT 'n' || n_nationkey, 'group', NULL, n_nationkey, 7, n_nationkey, n_name, 'related', 0 FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'person', NULL, c_custkey, 4, 0, c_name, 'subject', 0 FROM customer WHERE 'c' || c_custkey NOT IN (SELECT id FROM merged)"""
        extra_links = " UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'resident_in', 'relationship', NULL, c_custkey, 10, 0 FROM customer"
    q, d, flag = size
    only = "" if flag is None else f"WHERE l_quantity >= {q} AND l_discount >= {d} AND l_returnflag = '{flag}'"
    return f"""
WITH RECURSIVE picked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, l_shipdate, l_extendedprice) AS r
  FROM lineitem {only}
), h AS (
  SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, l_suppkey AS sk, l_partkey AS pk, o_custkey AS ck, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS prio
  FROM picked JOIN orders ON l_orderkey = o_orderkey WHERE r = 1
), seen AS (
  SELECT day, ok, 1 AS sec, ok AS key, 'release:' || ok AS id, 'release' AS kind, NULL AS role FROM h
  UNION ALL SELECT day, ok, 2, sk, 's' || sk, 'organization', CASE WHEN sk % 10 = 0 THEN 'authority' ELSE 'related' END FROM h
  UNION ALL SELECT day, ok, 3, pk, 'p' || pk, 'instrument', 'related' FROM h
  UNION ALL SELECT day, ok, 4, ck, 'c' || ck, 'person', 'subject' FROM h
  UNION ALL SELECT day, ok, 5, ln, 'r' || ok || ':' || ln, 'risk', NULL FROM h
  UNION ALL SELECT day, ok, 6, ok, 'm' || ok, 'matter', NULL FROM h
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY day DESC, ok DESC, sec, key) AS r FROM seen
), merged AS (
  SELECT p.id, p.kind, p.day, p.ok, p.sec, p.key, coalesce(s_name, p_name, c_name, p.id) AS label, p.role, n.refs
  FROM placed p JOIN (SELECT id, count(DISTINCT ok) AS refs FROM seen GROUP BY id) n ON n.id = p.id
  LEFT JOIN supplier ON p.id = 's' || s_suppkey LEFT JOIN part ON p.id = 'p' || p_partkey LEFT JOIN customer ON p.id = 'c' || c_custkey
  WHERE p.r = 1
), allnodes AS (
  SELECT id, kind, day, ok, sec, key, label, role, refs FROM merged{extra_nodes}
), node AS (
  SELECT *, row_number() OVER (ORDER BY day DESC NULLS LAST, ok DESC, sec, key) - 1 AS ord,
    coalesce(role, '') <> 'subject' AND (coalesce(role, '') = 'authority' OR refs > 10) AS authority
  FROM allnodes
), alllinks AS (
  SELECT 'release:' || ok AS source, 's' || sk AS target, 'mentions' AS kind, 'evidence' AS family, day, ok, 1 AS sec, ln AS key FROM h
  UNION ALL SELECT 'release:' || ok, 'p' || pk, 'mentions', 'evidence', day, ok, 2, ln FROM h
  UNION ALL SELECT 'release:' || ok, 'c' || ck, 'primary_mention', 'evidence', day, ok, 3, ln FROM h
  UNION ALL SELECT 'release:' || ok, 'r' || ok || ':' || ln, 'asserts', 'evidence', day, ok, 4, ln FROM h
  UNION ALL SELECT 'release:' || ok, 'm' || ok, 'reports', 'evidence', day, ok, 5, ln FROM h
  UNION ALL SELECT 'c' || ck, 'r' || ok || ':' || ln, 'subject_of', 'participation', day, ok, 6, ln FROM h
  UNION ALL SELECT 's' || sk, 'r' || ok || ':' || ln, 'authority_for', 'participation', day, ok, 7, ln FROM h
  UNION ALL SELECT 'r' || ok || ':' || ln, 'm' || ok, 'belongs_to', 'participation', day, ok, 8, ln FROM h
  UNION ALL SELECT 's' || sk, 'p' || pk, 'issuer_of', 'relationship', day, ok, 9, ln FROM h{extra_links}
), firstlinks AS (
  SELECT *, row_number() OVER (PARTITION BY source, target, kind, family ORDER BY day DESC NULLS LAST, ok DESC, sec, key) AS r FROM alllinks
), link AS (
  SELECT source, target, kind, family, row_number() OVER (ORDER BY day DESC NULLS LAST, ok DESC, sec, key, source, target, kind) - 1 AS ord FROM firstlinks WHERE r = 1
), rel AS (
  SELECT CAST(ok AS VARCHAR) AS ref, day, row_number() OVER (ORDER BY day DESC, ok DESC) - 1 AS ord FROM (SELECT DISTINCT ok, day FROM h)
), ok_node AS (SELECT id FROM node WHERE kind <> 'release' AND NOT authority
), edge AS MATERIALIZED (
  SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM link
  WHERE family <> 'evidence' AND source <> target AND source IN (SELECT id FROM ok_node) AND target IN (SELECT id FROM ok_node)
), adj AS MATERIALIZED (SELECT a AS src, b AS dst FROM edge UNION ALL SELECT b, a FROM edge
), deg AS (SELECT src AS id, count(*) AS degree FROM adj GROUP BY src
), way AS MATERIALIZED (SELECT source AS src, target AS dst, ord FROM link WHERE family <> 'evidence' UNION ALL SELECT target, source, ord FROM link WHERE family <> 'evidence'
), hub AS (
  SELECT n.id, coalesce(d.degree, 0) AS degree, authority, coalesce(d.degree, 0) > 40 OR authority AS hub FROM node n LEFT JOIN deg d ON d.id = n.id
)"""


_B = base(SMALL)
_PARTIES = "('person', 'organization', 'instrument')"
_SEED = "(SELECT id FROM node WHERE kind = '{0}' ORDER BY ord LIMIT 1)"


def _rank(values: str) -> str:
    return f""", val AS ({values})
SELECT n.id, label, kind, CAST(v AS DOUBLE) AS value, ord AS node_ord FROM node n JOIN val ON val.id = n.id
WHERE kind IN {_PARTIES} AND NOT authority AND v > 0 ORDER BY value DESC, lower(label), ord LIMIT 12"""


def _reach(seed: str, depth: int, hubs: bool) -> str:
    closed = "" if hubs else " AND w.dst NOT IN (SELECT id FROM hub WHERE hub)"
    return f""", reach AS (
  SELECT {seed} AS id, 0 AS hop
  UNION
  SELECT w.dst, r.hop + 1 FROM reach r JOIN way w ON w.src = r.id WHERE r.hop < {depth}{closed}
)
SELECT id, min(hop) AS hop FROM reach GROUP BY id"""


_SUB = """
SELECT 'node' AS part, id FROM node WHERE id IN (SELECT id FROM pick)
UNION ALL SELECT 'link', CAST(ord AS VARCHAR) FROM link WHERE source IN (SELECT id FROM pick) AND target IN (SELECT id FROM pick)
UNION ALL SELECT 'release', ref FROM rel WHERE ref IN (SELECT CAST(s.ok AS VARCHAR) FROM seen s WHERE s.id IN (SELECT id FROM pick))"""

_COMPONENT = """, comp AS (
  SELECT src AS id, src AS c FROM adj
  UNION
  SELECT adj.dst, comp.c FROM comp JOIN adj ON adj.src = comp.id WHERE comp.c < adj.dst
), part AS (SELECT id, min(c) AS component FROM (SELECT id, c FROM comp UNION ALL SELECT src, src FROM adj) GROUP BY id
)"""
_RANKS = """, n AS (SELECT count(*) AS n FROM deg
), pr AS (
  SELECT id, 0 AS i, 1.0::DOUBLE / (SELECT n FROM n) AS p FROM deg
  UNION ALL
  SELECT a.dst, pr.i + 1, 0.15 / (SELECT n FROM n) + 0.85 * sum(pr.p / d.degree) FROM pr JOIN adj a ON a.src = pr.id JOIN deg d ON d.id = pr.id WHERE pr.i < 50 GROUP BY a.dst, pr.i
)"""
_PAIRS = """, walk AS (
  SELECT id AS s, id AS v, 0 AS len, 1.0::DOUBLE AS paths FROM deg
  UNION ALL
  SELECT w.s, a.dst, w.len + 1, sum(w.paths) FROM walk w JOIN adj a ON a.src = w.v WHERE w.len < 40 GROUP BY w.s, a.dst, w.len
), near AS MATERIALIZED (SELECT s, v, min(len) AS dist, arg_min(paths, len) AS sigma FROM walk GROUP BY s, v
), between_ AS (
  SELECT x.v AS id, sum(x.sigma * y.sigma / z.sigma) AS total
  FROM near x JOIN near y ON y.s = x.v JOIN near z ON z.s = x.s AND z.v = y.v
  WHERE x.s <> x.v AND y.v <> x.v AND x.s <> y.v AND x.dist + y.dist = z.dist GROUP BY x.v
), bet AS (
  SELECT d.id, coalesce(total, 0) / (((SELECT count(*) FROM deg) - 1) * ((SELECT count(*) FROM deg) - 2)) AS betweenness FROM deg d LEFT JOIN between_ b ON b.id = d.id
)"""


def _cores(top: int = 4, rounds: int = 24) -> str:
    """Peeling, unrolled: for each k, drop nodes of degree below k, many times over."""
    out, alive = "", "SELECT id FROM deg"
    out += f", core1 AS MATERIALIZED ({alive})"
    for k in range(2, top + 1):
        last = f"core{k - 1}"
        for r in range(rounds):
            name = f"peel{k}_{r}" if r < rounds - 1 else f"core{k}"
            out += f", {name} AS MATERIALIZED (SELECT src AS id FROM adj WHERE src IN (SELECT id FROM {last}) AND dst IN (SELECT id FROM {last}) GROUP BY src HAVING count(*) >= {k})"
            last = name
    levels = " UNION ALL ".join(f"SELECT id, {k} AS k FROM core{k}" for k in range(1, top + 1))
    return out + f", cores AS (SELECT id, max(k) AS core FROM ({levels}) GROUP BY id)"


_STEP = "r.place || lpad(CAST(w.ord AS VARCHAR), 16, '0')"
_TRACE = f""", reach AS (
  SELECT {_SEED.format("person")} AS id, 0 AS hop, '' AS place, [{_SEED.format("person")}] AS ids, [CAST(NULL AS BIGINT)] AS ords
  UNION ALL
  SELECT w.dst, r.hop + 1, min({_STEP}), arg_min(list_append(r.ids, w.dst), {_STEP}), arg_min(list_append(r.ords, w.ord), {_STEP})
  FROM reach r JOIN way w ON w.src = r.id WHERE r.hop < 6 GROUP BY w.dst, r.hop
), first AS (SELECT id, min(hop) AS hop FROM reach GROUP BY id
), far AS (SELECT id, hop FROM first ORDER BY hop DESC, id DESC LIMIT 1)
SELECT CAST(generate_subscripts(ids, 1) - 1 AS BIGINT) AS step, unnest(ids) AS id, coalesce(unnest(ords), -1) AS link_ord FROM reach JOIN far USING (id, hop)"""

#: Parts of a result; ``chosen`` has id and pos, ``full`` whether more were left out.
_RESULT = """
SELECT 'node' AS part, id, CAST(pos AS BIGINT) AS pos, (SELECT cut FROM full_) AS truncated FROM chosen
UNION ALL SELECT 'link', CAST(ord AS VARCHAR), -1, (SELECT cut FROM full_) FROM link WHERE source IN (SELECT id FROM chosen) AND target IN (SELECT id FROM chosen)
UNION ALL SELECT 'release', ref, -1, (SELECT cut FROM full_) FROM rel WHERE ref IN (SELECT CAST(s.ok AS VARCHAR) FROM seen s WHERE s.id IN (SELECT id FROM chosen))"""


def _grown(seeds: str, caps: int, hops: int, hubs: bool) -> str:
    """Hop by hop in link order around ``seeds`` (id, pos), up to ``caps`` nodes in all."""
    closed = "" if hubs else " AND dst NOT IN (SELECT id FROM hub WHERE hub)"
    out, seen, count = f", hop0 AS ({seeds})", "SELECT id FROM hop0", "(SELECT count(*) FROM hop0)"
    for h in range(1, hops + 1):
        out += f""", cand{h} AS (SELECT dst AS id, min(ord) AS first FROM way WHERE src IN (SELECT id FROM hop{h - 1}) AND dst NOT IN ({seen}){closed} GROUP BY dst
), hop{h} AS (SELECT id, row_number() OVER (ORDER BY first, id) - 1 AS pos FROM cand{h} QUALIFY row_number() OVER (ORDER BY first, id) <= {caps} - {count})"""
        seen += f" UNION ALL SELECT id FROM hop{h}"
        count = "(" + " + ".join(f"(SELECT count(*) FROM hop{i})" for i in range(h + 1)) + ")"
    levels = " UNION ALL ".join(f"SELECT id, pos, {h} AS hop FROM hop{h}" for h in range(hops + 1))
    over = " OR ".join(f"(SELECT count(*) FROM cand{h}) > (SELECT count(*) FROM hop{h})" for h in range(1, hops + 1))
    return out + f", chosen AS (SELECT id, row_number() OVER (ORDER BY hop, pos) - 1 AS pos, hop FROM ({levels})), full_ AS (SELECT {over} AS cut)"


def oracle_sql() -> dict[str, str]:
    org, person = _SEED.format("organization"), _SEED.format("person")
    own = {
        "topology_edges": " SELECT a, b FROM edge",
        "degree": " SELECT id, degree FROM deg",
        "rank_degree": _rank("SELECT id, degree AS v FROM deg"),
        "rank_release_count": _rank("SELECT id, refs AS v FROM node"),
        "rank_pagerank": _RANKS + _rank("SELECT id, round(p, 7) AS v FROM pr WHERE i = 50"),
        "rank_betweenness": _PAIRS + _rank("SELECT id, round(betweenness, 7) AS v FROM bet"),
        "rank_core": _cores() + _rank("SELECT id, core AS v FROM cores"),
        "search_terms": """
SELECT id, label, kind, CAST(list_contains(regexp_extract_all(lower(label), '[a-z0-9]+'), 'supplier') AS INT) + CAST(list_contains(regexp_extract_all(lower(label), '[a-z0-9]+'), '00') AS INT) AS score, ord AS node_ord
FROM node WHERE contains(lower(label || ' ' || kind || ' ' || coalesce('involvement ' || role, '')), 'supplier') AND contains(lower(label || ' ' || kind), '00') ORDER BY score DESC, ord LIMIT 12""",
        "inspect_node": f"""
SELECT 'node' AS part, id FROM node WHERE id = {org}
UNION ALL SELECT 'link', CAST(ord AS VARCHAR) FROM link WHERE source = {org} OR target = {org}
UNION ALL (SELECT DISTINCT 'near', CASE WHEN source = {org} THEN target ELSE source END FROM link WHERE source = {org} OR target = {org})
UNION ALL SELECT 'near', {org}
UNION ALL (SELECT DISTINCT 'release', CAST(ok AS VARCHAR) FROM seen WHERE id = {org})""",
        "focus_subgraph": ", pick AS (SELECT id FROM node WHERE kind IN ('person', 'risk', 'release'))" + _SUB,
        "filter_subgraph": f""", pick AS (SELECT id FROM node WHERE kind IN {_PARTIES})
SELECT 'node' AS part, id FROM pick
UNION ALL SELECT 'link', CAST(ord AS VARCHAR) FROM link WHERE family IN ('participation', 'relationship') AND source IN (SELECT id FROM pick) AND target IN (SELECT id FROM pick)
UNION ALL SELECT 'release', ref FROM rel""",
        "overview_graph": """, fresh AS (SELECT 'release:' || ref AS id FROM rel ORDER BY day DESC, ord LIMIT 50
), pick AS (SELECT id FROM fresh UNION SELECT target FROM link WHERE kind IN ('primary_mention', 'reports', 'asserts') AND source IN (SELECT id FROM fresh))""" + _SUB,
        "expand_nodes": _reach(org, 1, True),
        "neighborhood_d1": _reach(person, 1, False),
        "neighborhood_d2": _reach(person, 2, False),
        "neighborhood_d3": _reach(person, 3, False),
        "neighborhood_capped": """, seed AS (SELECT id FROM node WHERE kind = 'person' ORDER BY ord LIMIT 3
), cand AS (SELECT dst AS id, min(ord) AS first FROM way WHERE src IN (SELECT id FROM seed) AND dst NOT IN (SELECT id FROM seed) AND dst NOT IN (SELECT id FROM hub WHERE hub) GROUP BY dst
), few AS (SELECT id FROM cand ORDER BY first, id LIMIT 3)
SELECT id, 0 AS hop FROM seed UNION ALL SELECT id, 1 FROM few""",
        "trace_path": _TRACE,
        "components": _COMPONENT + " SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM part",
        "component_graph": _COMPONENT + _RANKS + f""", own AS (
  SELECT n.id, row_number() OVER (ORDER BY n.id <> {person}, round(p, 7) DESC, lower(label), ord) - 1 AS pos FROM part JOIN node n ON n.id = part.id JOIN pr ON pr.id = n.id AND pr.i = 50
  WHERE component = (SELECT component FROM part WHERE id = {person})
), chosen AS (SELECT id, pos FROM own WHERE pos < 80), full_ AS (SELECT count(*) > 80 AS cut FROM own)""" + _RESULT,
        "neighborhood_result": _grown("SELECT id, row_number() OVER (ORDER BY ord) - 1 AS pos FROM node WHERE kind = 'person' ORDER BY ord LIMIT 5", 12, 2, False) + _RESULT,
        "neighborhood_people": _grown("SELECT id, row_number() OVER (ORDER BY ord) - 1 AS pos FROM node WHERE kind = 'organization' ORDER BY ord LIMIT 3", 80, 3, True) + " SELECT n.id, label, CAST(hop AS BIGINT) AS hop FROM chosen c JOIN node n ON n.id = c.id WHERE kind IN ('person', 'group')",
        "view_ego": _grown(f"SELECT {person} AS id, 0 AS pos", 80, 1, True) + _RESULT.replace("(SELECT cut FROM full_)", "false"),
        "metric_facts": _COMPONENT + _cores() + """, sized AS (SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM part)
SELECT id, 'degree' AS name, CAST(degree AS VARCHAR) AS value FROM deg
UNION ALL SELECT id, 'releaseCount', CAST(refs AS VARCHAR) FROM node WHERE refs > 0
UNION ALL SELECT n.id, 'componentSize', CAST(coalesce(size, 1) AS VARCHAR) FROM node n LEFT JOIN sized s ON s.id = n.id
UNION ALL SELECT id, 'component', component FROM sized
UNION ALL SELECT id, 'core', CAST(core AS VARCHAR) FROM cores""",
        "pagerank": _RANKS + " SELECT id, round(p, 7) AS pagerank FROM pr WHERE i = 50",
        "betweenness": _PAIRS + " SELECT id, round(betweenness, 7) AS betweenness FROM bet",
        "core_number": _cores() + " SELECT id, CAST(core AS BIGINT) AS core FROM cores",
        "graph_summary": _COMPONENT + """, sized AS (SELECT component, count(*) AS n FROM part GROUP BY component)
SELECT (SELECT min(day) FROM rel) AS first_day, (SELECT max(day) FROM rel) AS last_day, (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM link) AS links, (SELECT count(*) FROM rel) AS releases,
  (SELECT count(*) FROM sized) AS components, (SELECT count(*) FROM node) - (SELECT count(*) FROM part) AS outside, (SELECT coalesce(max(n), 0) FROM sized) AS largest""",
        "kind_counts": " SELECT kind AS value, count(*) AS n FROM node GROUP BY kind",
        "family_counts": " SELECT family AS value, count(*) AS n FROM link GROUP BY family",
    }
    out = {name: _B + sql for name, sql in own.items()}
    family = "CASE kind WHEN 'release' THEN 'source' WHEN 'matter' THEN kind WHEN 'risk' THEN kind WHEN 'action' THEN kind ELSE 'entity' END"
    out["authority_flags"] = base(LARGE) + f" SELECT id, authority, {family} AS node_family FROM node"
    out["hub_flags"] = base(LARGE, True) + " SELECT id, degree, authority, hub FROM hub"
    for name in ("degree", "rank_degree", "components", "pagerank", "search_terms", "neighborhood_result", "overview_graph"):
        out[f"{name}_all"] = base(ALL) + own[name]
    out["components_large"] = base(LARGE) + _COMPONENT + " SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM part"
    return out
