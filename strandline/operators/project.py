"""Projection of extraction records to the evidence graph, with order kept in ordinals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import entity_id, normalize_name, stripped, title_label
from strandline.graph import AUTHORITY_RELEASES, FACETS, FACTS, EvidenceGraph, involvement
from strandline.operators.evidence import unwrapped
from strandline.operators.order import ordered
from strandline.schema import EXTRACTION
from strandline.session import cut
from strandline.taxonomy import ACTION_TYPES, RISK_TYPES, family_of

PLACE = "struct<r:bigint,section:int,item:bigint,step:int,sub:int>"
#: Where releases are found unless another address is given.
URL = "https://example.org/news?refNo="


def _fact(name: Column, value: Column, quote: Column) -> Column:
    return F.struct(name.alias("name"), value.alias("value"), quote.alias("evidence"), F.col("ref").alias("releaseRef"))


def _facts(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p.cast(FACTS), F.array().cast(FACTS)) for p in parts]).cast(FACTS)


def _attributes(x: Column) -> Column:
    return F.transform(x, lambda a: _fact(a["name"], a["value"], a["evidence"]["quote"]))


def _places(x: Column) -> Column:
    return F.transform(x, lambda g: _fact(F.concat(F.lit("geography_"), g["role"]), g["name"], g["evidence"]["quote"]))


def _sourced(name: str, x: Column) -> Column:
    return F.transform(x, lambda s: _fact(F.lit(name), s["value"], s["evidence"]["quote"]))


def _optional(*pairs: tuple[str, Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(v.isNotNull() & (v != ""), _fact(F.lit(n), v, q)) for n, v, q in pairs]))


def _period(p: Column) -> Column:
    quote = F.coalesce(p["evidence"]["quote"], p["text"])
    return _optional(("period", p["text"], quote), ("period_start", p["start"], quote), ("period_end", p["end"], quote))


def _money(m: Column) -> Column:
    q = m["evidence"]["quote"]
    return _optional(("amount", m["text"], q), ("amount_currency", m["currency"], q), ("amount_normalized", m["amount"], q), ("amount_qualifier", m["qualifier"], q))


def _family(families: dict, c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in family_of(families).items() for x in pair])
    return F.coalesce(F.element_at(table, c), F.lit("other"))


def _facets(**kinds: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), v)]).cast(FACETS), lambda k, v: v.isNotNull())


def _at(section: int, step: int, sub: Column | int = 0) -> Column:
    sub = F.lit(sub) if isinstance(sub, int) else sub
    return F.struct(F.col("r").alias("r"), F.lit(section).alias("section"), F.col("item").cast("long").alias("item"), F.lit(step).alias("step"), sub.alias("sub")).cast(PLACE)


def parse(current: DataFrame, newest: int | None = None) -> DataFrame:
    """r (release order, newest first by issue date and ref as texts), ref, title, issueDate and the typed record of each current extraction, however it is wrapped.

    ``newest``: of so many releases only, those that come first.
    """
    rows = current.select(F.col("source_ref").alias("ref"), F.col("issue_date").alias("issueDate"), "raw_json", "extraction_json")
    if newest is not None:
        rows = rows.orderBy(F.desc("issueDate"), F.desc("ref")).limit(newest)
    # Written before it is put in order, which reads it more than once.
    rows = cut(rows.select("ref", "issueDate", F.get_json_object("raw_json", "$.title").alias("title"), F.from_json(unwrapped(F.col("extraction_json")), EXTRACTION).alias("x")))
    return cut(ordered(rows, "r", F.desc("issueDate"), F.desc("ref")).select("r", "ref", "title", "issueDate", "x"), rows)


@dataclass(frozen=True)
class Projection:
    """What records name and claim, with its place (``at``), and the releases. Nodes and links are merged and put in order only where they are read."""

    named: DataFrame
    claimed: DataFrame
    releases: DataFrame

    def nodes(self) -> DataFrame:
        return ordered(merge(self.named), "node_ord", "at", "id").select("node_ord", "id", "label", "kind", "summary", "releaseRefs", "facets", "facts")

    def labels(self) -> DataFrame:
        """node_ord, id, label and kind of the nodes: those of the first naming."""
        first = self.named.groupBy("id").agg(F.min_by(F.struct("at", "label", "kind"), "at").alias("f"))
        return ordered(first.select("id", "f.*"), "node_ord", "at", "id").select("node_ord", "id", "label", "kind")

    def links(self, *columns: str) -> DataFrame:
        """The links, with these columns besides link_ord; none stands for all."""
        columns = columns or ("source", "target", "kind", "family", "evidence", "releaseRef", "facets", "facts")
        keys = ("at", "source", "target", "kind")
        return ordered(self.claimed.select(*dict.fromkeys((*keys, *columns))), "link_ord", *keys).select("link_ord", *columns)

    def graph(self) -> EvidenceGraph:
        return EvidenceGraph(self.nodes(), self.links(), self.releases)

    def topology(self) -> DataFrame:
        """The topology of the graph; nothing has to be merged or put in order for it but who is an authority."""
        roles = involvement(F.col("facets"))
        # As in the merged facets: null where the role is not there, but a null is.
        has = lambda role: F.when(F.max(F.coalesce(F.array_contains(roles, role), F.lit(False))), True).when(F.max(F.exists(roles, F.isnull)), F.lit(None)).otherwise(False)
        seen = self.named.groupBy("id").agg(F.min_by("kind", "at").alias("kind"), F.count_distinct("ref").alias("n"), has("subject").alias("subject"), has("authority").alias("authority"))
        eligible = cut(seen.where((F.col("kind") != "release") & ~(~F.col("subject") & (F.col("authority") | (F.col("n") > AUTHORITY_RELEASES)))).select("id"))
        pairs = self.claimed.where((F.col("family") != "evidence") & (F.col("source") != F.col("target")))
        pairs = pairs.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
        return pairs.join(eligible.withColumnRenamed("id", "a"), "a", "left_semi").join(eligible.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")


def project(current: DataFrame, links: DataFrame, language: str = "EN", url: str = URL) -> EvidenceGraph:
    """The evidence graph of the current extractions and the reference links between their releases (``projection``)."""
    return projection(current, links, language, url).graph()


def projection(current: DataFrame, links: DataFrame, language: str = "EN", url: str = URL, newest: int | None = None) -> Projection:
    """The evidence graph of the current extractions and the reference links between their releases.

    ``current``: source_ref, issue_date, raw_json, extraction_json, one row
    per release. Order is that of the records: release, mentions,
    relationships, matters, risks, actions; of a node met again the first
    naming counts, and what it adds is appended. Records that can't be read
    give their release node only. References to a mention or matter the record
    lacks make no link. Releases that are linked but have no extraction come
    last, in order of the links (by source, then target). With ``newest``, of
    so many releases only, whose nodes and links are first in the whole graph.
    """
    base = parse(current, newest)
    one = lambda name: base.select("r", "ref", "x", F.posexplode(F.col(f"x.{name}")).alias("item", "v")).where("v is not null")
    v = F.col("v")
    kind = F.when(v["type"] == "person_group", "group").when(v["type"] == "financial_instrument", "instrument").otherwise(v["type"])
    mentions = one("mentions").withColumn("kind", kind).withColumn("_norm", normalize_name(v["name"]))
    mentions = cut(mentions.withColumn("id", entity_id(F.col("kind"), v["name"], F.col("ref"), v["id"], F.col("_norm"))).drop("_norm", "x"))
    globally = mentions.select("r", v["id"].alias("local"), "id").dropDuplicates(["r", "local"])
    ev = v["evidence"]["quote"]
    merged = F.col("id").startswith("entity:")
    strings = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    node = lambda at, id_, label, kind_, text, facets, facts: (at.alias("at"), id_.alias("id"), label.alias("label"), kind_.alias("kind"), text.alias("summary"), F.col("ref").alias("ref"), facets.alias("facets"), facts.alias("facts"))
    link = lambda at, s, t, k, family, q, facets=None, facts=None: (at.alias("at"), s.alias("source"), t.alias("target"), (F.lit(k) if isinstance(k, str) else k).alias("kind"), F.lit(family).alias("family"), q.alias("evidence"), F.col("ref").alias("releaseRef"), (facets if facets is not None else F.from_json(F.lit("{}"), FACETS)).alias("facets"), (facts if facts is not None else F.array().cast(FACTS)).alias("facts"))
    release_id = F.concat(F.lit("release:"), "ref")
    nil = F.from_json(F.lit("{}"), FACETS)
    releases = base.withColumn("item", F.lit(0))
    nodes = releases.select(*node(_at(0, 0), release_id, F.concat_ws(" · ", "ref", stripped(F.col("title"))), F.lit("release"), F.col("title"), nil, F.array().cast(FACTS)))
    nodes = nodes.unionByName(mentions.select(*node(_at(1, 0), F.col("id"), v["name"], F.col("kind"), v["description"], _facets(identity=F.array(F.when(merged, "exact_name").otherwise("release_local")), involvement=v["involvement"]), _facts(F.when(merged, F.array(_fact(F.lit("description"), v["description"], ev))), F.transform(strings(v["aliases"]), lambda a: _fact(F.lit("alias"), a, ev)), _places(v["geographies"]), _attributes(v["attributes"])))))
    out = mentions.select(*link(_at(1, 1), release_id, F.col("id"), F.when(v["relevance"] == "primary", "primary_mention").otherwise("mentions"), "evidence", ev))
    related = one("relationships").withColumn("_s", v["subject_id"]).join(globally.select("r", F.col("local").alias("_s"), F.col("id").alias("sid")), ["r", "_s"]).withColumn("_o", v["object_id"]).join(globally.select("r", F.col("local").alias("_o"), F.col("id").alias("oid")), ["r", "_o"])
    out = out.unionByName(related.select(*link(_at(2, 0), F.col("sid"), F.col("oid"), v["predicate"], "relationship", ev, _facets(relationship_kind=F.array(v["kind"]), claim_status=F.array(F.coalesce(v["status"], F.lit("reported"))), negated=F.array(F.coalesce(v["negated"], F.lit(False)).cast("string"))), _facts(_period(v["period"]), _attributes(v["attributes"])))))
    matters = one("matters").withColumn("id", F.concat(F.lit("matter:"), "ref", F.lit(":"), v["id"]))
    risks = one("risks").withColumn("id", F.concat(F.lit("risk:"), "ref", F.lit(":"), v["id"]))
    actions = one("actions").withColumn("id", F.concat(F.lit("action:"), "ref", F.lit(":"), v["id"]))
    nodes = nodes.unionByName(matters.select(*node(_at(3, 0), F.col("id"), title_label(v["kind"]), F.lit("matter"), v["description"], _facets(matter_kind=F.array(v["kind"])), _facts(_sourced("case_number", v["case_numbers"]), _sourced("legal_provision", v["legal_provisions"])))))
    nodes = nodes.unionByName(risks.select(*node(_at(4, 0), F.col("id"), v["label"], F.lit("risk"), v["description"], _facets(risk_family=F.array(_family(RISK_TYPES, v["type"])), risk_type=F.array(v["type"]), claim_status=F.array(v["status"]), negated=F.array(F.coalesce(v["negated"], F.lit(False)).cast("string"))), _facts(_period(v["period"]), _places(v["geographies"]), _attributes(v["attributes"])))))
    nodes = nodes.unionByName(actions.select(*node(_at(5, 0), F.col("id"), v["label"], F.lit("action"), v["description"], _facets(action_family=F.array(_family(ACTION_TYPES, v["type"])), action_type=F.array(v["type"]), action_status=F.array(v["status"])), _facts(_money(v["amount"]), _optional(("duration", v["duration"], ev)), _period(v["period"]), _places(v["geographies"]), _attributes(v["attributes"])))))
    known_matter = matters.select("r", v["id"].alias("_m"), F.col("id").alias("mid"))
    for section, rows, verb, roles in ((3, matters, "reports", ("authority", "subject")), (4, risks, "asserts", ("authority", "subject", "affected")), (5, actions, "reports", ("actor", "target", "affected"))):
        out = out.unionByName(rows.select(*link(_at(section, 1), release_id, F.col("id"), verb, "evidence", ev)))
        if section > 3:
            out = out.unionByName(rows.withColumn("_m", v["matter_id"]).join(known_matter, ["r", "_m"]).select(*link(_at(section, 2), F.col("id"), F.col("mid"), "belongs_to", "participation", ev)))
        for n, role in enumerate(roles):
            named = rows.select("r", "ref", "item", "v", "id", F.posexplode(strings(v[f"{role}_ids"])).alias("p", "local")).join(globally.withColumnRenamed("id", "gid"), ["r", "local"])
            verb_in = {"authority": "authority_for", "subject": "subject_of", "affected": "affected_by", "actor": "actor_of", "target": "target_of"}[role]
            out = out.unionByName(named.select(*link(_at(section, 3 + n, F.col("p")), F.col("gid"), F.col("id"), verb_in, "participation", ev)))
    known = base.select("ref").distinct()
    refs = links.where(F.col("language") == language).select(F.col("source_ref").alias("s"), F.col("target_ref").alias("t")).distinct().join(known, F.col("s") == F.col("ref"), "left_semi")
    refs = cut(ordered(refs, "n", "s", "t"))
    after = lambda n: F.struct(F.lit(1 << 40).cast("long").alias("r"), F.lit(9).alias("section"), n.alias("item"), F.lit(0).alias("step"), F.lit(0).alias("sub")).cast(PLACE)
    out = out.unionByName(refs.select(after(F.col("n")).alias("at"), F.concat(F.lit("release:"), "s").alias("source"), F.concat(F.lit("release:"), "t").alias("target"), F.lit("references").alias("kind"), F.lit("evidence").alias("family"), F.lit("Linked release").alias("evidence"), F.col("s").alias("releaseRef"), nil.alias("facets"), F.array().cast(FACTS).alias("facts")))
    stubs = refs.join(known, F.col("t") == F.col("ref"), "left_anti").groupBy("t").agg(F.min("n").alias("n"))
    nodes = nodes.unionByName(stubs.select(after(F.col("n")).alias("at"), F.concat(F.lit("release:"), "t").alias("id"), F.col("t").alias("label"), F.lit("release").alias("kind"), F.lit("A linked release without a current extraction.").alias("summary"), F.col("t").alias("ref"), nil.alias("facets"), F.array().cast(FACTS).alias("facts")))
    listed = base.select(F.col("r").alias("release_ord"), "ref", stripped(F.col("title")).alias("title"), "issueDate", F.concat(F.lit(url), "ref").alias("url"))
    return Projection(nodes, out, listed)


def merge(candidates: DataFrame) -> DataFrame:
    """One node per id: the first candidate as it is, then unseen refs, facts and facet values of later ones, in order.

    Values are made distinct on the map side before any list is gathered, so
    a list is never longer than the node's own.
    """
    first = candidates.groupBy("id").agg(F.min_by(F.struct("at", "label", "kind", "summary", "ref", "facets", "facts"), "at").alias("f"))
    refs = _rest(candidates.select("id", "at", F.lit(0).alias("sub"), F.col("ref").alias("value")), ("id",), "refs")
    facts = _rest(candidates.select("id", "at", F.posexplode("facts").alias("sub", "value")), ("id",), "more")
    facets = candidates.select("id", "at", F.explode("facets").alias("key", "values"))
    own = facets.groupBy("id", "key").agg(F.min_by("values", "at").alias("own"))
    other = _rest(facets.select("id", "key", "at", F.posexplode("values").alias("sub", "value")), ("id", "key"), "more")
    joined = own.join(other, ["id", "key"], "left").select("id", "key", _extended(F.col("own"), F.col("more")).alias("values"))
    maps = joined.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "values")))).alias("facets"))
    out = first.join(refs, "id").join(facts, "id", "left").join(maps, "id", "left")
    return out.select("id", "f.at", "f.label", "f.kind", "f.summary", F.col("refs").alias("releaseRefs"), F.coalesce("facets", F.from_json(F.lit("{}"), FACETS)).alias("facets"), _extended(F.col("f.facts"), F.col("more")).alias("facts"))


def _rest(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    distinct = rows.groupBy(*keys, "value").agg(F.min(F.struct("at", "sub")).alias("o"))
    return distinct.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "value"))), lambda x: x["value"]).alias(name))


def _extended(own: Column, every: Column) -> Column:
    return F.when(every.isNull(), own).otherwise(F.concat(own, F.array_except(every, own)))
