"""The evidence graph that the registered graph queries run on, projected from the order tables.

Order lines are the claims: each is a risk, each order a release and a matter,
each customer, supplier and part a party. ``ALL`` is the graph of all lines;
``SMALL`` and ``LARGE`` are of returned, large and strongly discounted lines
only, for queries whose SQL can't follow on more.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.graph import AUTHORITY_RELEASES, FACETS, FACTS, EvidenceGraph
from strandline.operators.order import ordered
from strandline.session import cut, table

#: Least quantity and discount, and the return flag (None for any).
Size = tuple[int, float, str | None]
SMALL: Size = (49, 0.08, "R")
LARGE: Size = (45, 0.05, "R")
ALL: Size = (0, 0.0, None)


def lines(spark: SparkSession, sf_dir: str, quantity: int, discount: float, flag: str | None) -> DataFrame:
    """One line per (order, line number): the first by supplier, part, ship date and price."""
    item, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = item if flag is None else item.where((F.col("l_quantity") >= quantity) & (F.col("l_discount") >= discount) & (F.col("l_returnflag") == flag))
    # Lines move once, to their order: the first has the least supplier, then part, and nothing else of it is used.
    first = rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_suppkey", "l_partkey")).alias("_f"))
    rows = first.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").cast("long").alias("ln"), F.col("_f.l_suppkey").alias("sk"), F.col("_f.l_partkey").alias("pk"), F.col("o_custkey").alias("ck"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("prio"))


def fixture_graph(spark: SparkSession, sf_dir: str, size: Size = SMALL, residents: bool = False) -> EvidenceGraph:
    """The graph; with ``residents`` every customer is linked to a node of its nation."""
    h = cut(lines(spark, sf_dir, *size))
    s = F.lit
    facet = lambda role: F.create_map(s("involvement"), F.array(role))
    none = F.from_json(s("{}"), FACETS)
    supplier = h.select("day", "ok", s(2).alias("sec"), F.col("sk").alias("key"), s(0).cast("long").alias("sub"), F.concat(s("s"), "sk").alias("id"), s("organization").alias("kind"), facet(F.when(F.col("sk") % 10 == 0, "authority").otherwise("related")).alias("facets"))
    part = h.select("day", "ok", s(3).alias("sec"), F.col("pk").alias("key"), s(0).cast("long").alias("sub"), F.concat(s("p"), "pk").alias("id"), s("instrument").alias("kind"), facet(s("related")).alias("facets"))
    customer = h.select("day", "ok", s(4).alias("sec"), F.col("ck").alias("key"), s(0).cast("long").alias("sub"), F.concat(s("c"), "ck").alias("id"), s("person").alias("kind"), facet(s("subject")).alias("facets"))
    risk = h.select("day", "ok", s(5).alias("sec"), F.col("ln").alias("key"), s(0).cast("long").alias("sub"), F.concat(s("r"), "ok", s(":"), "ln").alias("id"), s("risk").alias("kind"), none.alias("facets"))
    matter = h.select("day", "ok", s(6).alias("sec"), F.col("ok").alias("key"), s(0).cast("long").alias("sub"), F.concat(s("m"), "ok").alias("id"), s("matter").alias("kind"), none.alias("facets"))
    release = h.select("day", "ok", s(1).alias("sec"), F.col("ok").alias("key"), s(0).cast("long").alias("sub"), F.concat(s("release:"), "ok").alias("id"), s("release").alias("kind"), none.alias("facets"))
    seen = release.unionByName(supplier).unionByName(part).unionByName(customer).unionByName(risk).unionByName(matter)
    # First occurrence (newest order first) gives the place; the refs are all orders, newest first.
    merged = seen.groupBy("id", "kind").agg(
        F.min(F.struct((-F.unix_date(F.to_date("day"))).alias("d"), (-F.col("ok")).alias("o"), "sec", "key", "sub")).alias("at"),
        F.first("facets").alias("facets"),
        F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct((-F.unix_date(F.to_date("day"))).alias("d"), (-F.col("ok")).alias("o")))), lambda x: F.concat(F.lit(""), (-x["o"]).cast("string")))).alias("releaseRefs"),
    )
    names = (
        table(spark, sf_dir, "supplier").select(F.concat(s("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"))
        .unionByName(table(spark, sf_dir, "part").select(F.concat(s("p"), "p_partkey").alias("id"), F.col("p_name").alias("name")))
        .unionByName(table(spark, sf_dir, "customer").select(F.concat(s("c"), "c_custkey").alias("id"), F.col("c_name").alias("name")))
    )
    merged = merged.join(names, "id", "left").withColumn("label", F.coalesce("name", "id"))
    if residents:
        homes = table(spark, sf_dir, "customer").select(F.concat(s("c"), "c_custkey").alias("id"), "c_name", "c_nationkey")
        nations = table(spark, sf_dir, "nation").select(F.concat(s("n"), "n_nationkey").alias("id"), s("group").alias("kind"), F.struct(s(10**6).cast("int").alias("d"), F.col("n_nationkey").cast("long").alias("o"), s(7).alias("sec"), F.col("n_nationkey").cast("long").alias("key"), s(0).cast("long").alias("sub")).alias("at"), facet(s("related")).alias("facets"), F.array().cast("array<string>").alias("releaseRefs"), F.col("n_name").alias("name"), F.col("n_name").alias("label"))
        others = homes.join(merged.select("id"), "id", "left_anti").select("id", s("person").alias("kind"), F.struct(s(10**6 + 1).cast("int").alias("d"), F.regexp_extract("id", r"(\d+)", 1).cast("long").alias("o"), s(4).alias("sec"), s(0).cast("long").alias("key"), s(0).cast("long").alias("sub")).alias("at"), facet(s("subject")).alias("facets"), F.array().cast("array<string>").alias("releaseRefs"), F.col("c_name").alias("name"), F.col("c_name").alias("label"))
        merged = merged.unionByName(nations).unionByName(others)
    nodes = ordered(merged, "node_ord", "at").select("node_ord", "id", "label", "kind", F.concat_ws(" ", "kind", "label").alias("summary"), "releaseRefs", "facets", F.array().cast(FACTS).alias("facts"))
    link = lambda sec, src, dst, kind, family, sub=s(0): h.select("day", "ok", s(sec).alias("sec"), F.col("ln").alias("key"), sub.cast("long").alias("sub"), src.alias("source"), dst.alias("target"), s(kind).alias("kind"), s(family).alias("family"))
    c = {"rel": F.concat(s("release:"), "ok"), "s": F.concat(s("s"), "sk"), "p": F.concat(s("p"), "pk"), "c": F.concat(s("c"), "ck"), "r": F.concat(s("r"), "ok", s(":"), "ln"), "m": F.concat(s("m"), "ok")}
    raw = link(1, c["rel"], c["s"], "mentions", "evidence")
    for x in (
        link(2, c["rel"], c["p"], "mentions", "evidence"), link(3, c["rel"], c["c"], "primary_mention", "evidence"), link(4, c["rel"], c["r"], "asserts", "evidence"), link(5, c["rel"], c["m"], "reports", "evidence"),
        link(6, c["c"], c["r"], "subject_of", "participation"), link(7, c["s"], c["r"], "authority_for", "participation"), link(8, c["r"], c["m"], "belongs_to", "participation"), link(9, c["s"], c["p"], "issuer_of", "relationship"),
    ):
        raw = raw.unionByName(x)
    found = raw.groupBy("source", "target", "kind", "family").agg(F.min(F.struct((-F.unix_date(F.to_date("day"))).alias("d"), (-F.col("ok")).alias("o"), "sec", "key", "sub")).alias("at"))
    if residents:
        found = found.unionByName(table(spark, sf_dir, "customer").select(F.concat(s("c"), "c_custkey").alias("source"), F.concat(s("n"), "c_nationkey").alias("target"), s("resident_in").alias("kind"), s("relationship").alias("family"), F.struct(s(10**6).cast("int").alias("d"), F.col("c_custkey").cast("long").alias("o"), s(10).alias("sec"), s(0).cast("long").alias("key"), s(0).cast("long").alias("sub")).alias("at")))
    links = ordered(found, "link_ord", "at", "source", "target", "kind").select("link_ord", "source", "target", "kind", "family", F.concat_ws(" ", "source", "kind", "target").alias("evidence"), F.when(F.col("at.d") < 10**6, (-F.col("at.o")).cast("string")).alias("releaseRef"), none.alias("facets"), F.array().cast(FACTS).alias("facts"))
    rel = ordered(h.select("day", "ok", "prio").distinct().withColumn("at", F.struct((-F.unix_date(F.to_date("day"))).alias("d"), (-F.col("ok")).alias("o"))), "release_ord", "at").select("release_ord", F.col("ok").cast("string").alias("ref"), F.col("prio").alias("title"), F.col("day").alias("issueDate"), F.concat(s("https://example.org/"), F.col("ok").cast("string")).alias("url"))
    return EvidenceGraph(cut(nodes), cut(links), cut(rel))


@dataclass(frozen=True)
class PlacedGraph(EvidenceGraph):
    """The same graph as plans over the lines, of which a query runs only what it reads.

    node_ord, link_ord and release_ord are places (structs that sort like the
    ordinals); ``dense`` turns those of a result into ordinals. Nodes have
    ``n_refs`` (how many releases they refer to) besides the refs.
    """

    spark: SparkSession
    sf_dir: str
    h: DataFrame

    def flagged(self) -> DataFrame:
        roles = F.coalesce(F.col("facets")["involvement"], F.array().cast("array<string>"))
        return self.nodes.withColumn("authority", ~F.array_contains(roles, "subject") & (F.array_contains(roles, "authority") | (F.col("n_refs") > AUTHORITY_RELEASES)))

    @cached_property
    def suppliers(self) -> DataFrame:
        """sk of the suppliers that are no authorities."""
        return cut(_few(self.h, "sk", "s_first").where("sk % 10 <> 0"))

    @cached_property
    def edges(self) -> DataFrame:
        """a, b of the topology with the kinds of both."""
        return self.edges_of(self.h)

    def edges_of(self, h: DataFrame) -> DataFrame:
        """The edges that lines make. Only suppliers and parts can be authorities; they are told apart by their keys."""
        s = F.lit
        part = lambda rows, a, b, a_kind, b_kind: rows.select(a.alias("a"), b.alias("b"), s(a_kind).alias("a_kind"), s(b_kind).alias("b_kind"))
        out = part(h.where("ck is not null"), _id("c"), _id("r"), "person", "risk").unionByName(part(h, _id("m"), _id("r"), "matter", "risk"))
        if self.suppliers.isEmpty():
            return out
        parts = cut(_few(self.h, "pk", "p_first"))
        out = out.unionByName(part(h.join(self.suppliers, "sk", "left_semi"), _id("r"), _id("s"), "risk", "organization"))
        return out.unionByName(part(h.join(self.suppliers, "sk", "left_semi").join(parts, "pk", "left_semi").select("sk", "pk").distinct(), _id("p"), _id("s"), "instrument", "organization"))

    def topology(self) -> DataFrame:
        return self.edges.select("a", "b")

    def ends(self, kinds: Sequence[str]) -> DataFrame:
        way = lambda x, y: self.edges.where(F.col(f"{x}_kind").isin(*kinds)).select(F.col(x).alias("src"), F.col(y).alias("dst"))
        return way("a", "b").unionByName(way("b", "a"))

    def degrees(self) -> DataFrame:
        """kind, key, degree of the parties in the topology: customers by the sizes of their orders, the others by their edges."""
        own = self.h.where("o_first and ck is not null").groupBy(F.col("ck").alias("key")).agg(F.sum(F.size("lns")).cast("long").alias("degree"))
        out = own.select(F.lit("ck").alias("kind"), "key", "degree")
        if self.suppliers.isEmpty():
            return out
        met = self.h.join(self.suppliers, "sk", "left_semi").join(cut(_few(self.h, "pk", "p_first")).select(F.col("pk").alias("_pk")), F.col("pk") == F.col("_pk"), "left")
        issued = cut(met.select("ok", "ln", "sk", "_pk"))
        for kind, sees in (("sk", F.count(F.lit(1)) + F.count_distinct("_pk")), ("_pk", F.count_distinct("sk"))):
            out = out.unionByName(issued.where(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("key")).agg(sees.alias("degree")).select(F.lit(kind.lstrip("_")).alias("kind"), "key", "degree"))
        return out

    def leading(self, limit: int) -> tuple[PlacedGraph, DataFrame]:
        """The graph of the lines that name a party of the ``limit`` greatest degrees (more where degrees tie), in which just these are whole, and their id and degree."""
        every = cut(self.degrees())
        least = every.orderBy(F.desc("degree")).limit(limit).agg(F.min("degree").alias("_least"))
        top = cut(every.join(F.broadcast(least), F.col("degree") >= F.col("_least")).select("kind", "key", "degree"))
        h = self.h
        for key in ("sk", "pk", "ck"):
            h = h.join(top.where(F.col("kind") == key).select(F.col("key").alias(key), F.lit(True).alias(f"_{key}")), key, "left")
        h = cut(h.where("_sk or _pk or _ck").select(*self.h.columns))
        return replace(self, nodes=nodes_of(self.spark, self.sf_dir, h)), top.select(F.concat(F.substring("kind", 1, 1), "key").alias("id"), "degree")

    def dense(self, found: DataFrame, name: str) -> DataFrame:
        """``found`` with ordinals for its places in column ``name``.

        Places begin with the order, newest first. So the graph of the orders
        up to the last that is found has the same ordinals for these.
        """
        found = cut(found)
        last = found.agg(F.max(F.struct(f"{name}.d", f"{name}.o")).alias("_last"))
        own = cut(self.h.crossJoin(F.broadcast(last)).where(F.struct(_day().alias("d"), (-F.col("ok")).alias("o")) <= F.col("_last")).drop("_last"))
        rows = {"node_ord": nodes_of(self.spark, self.sf_dir, own), "link_ord": links_of(own)}[name].select(F.col(name).alias("_at"))
        placed = ordered(rows.join(F.broadcast(found.agg(F.max(name).alias("_max"))), F.col("_at") <= F.col("_max")).select("_at"), "_n", "_at")
        return found.join(placed, F.col(name).eqNullSafe(F.col("_at")), "left").withColumn(name, F.col("_n")).select(*found.columns)


def _few(h: DataFrame, key: str, first: str) -> DataFrame:
    """The keys that are in no more orders than an authority is."""
    return h.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_if(F.col(first)).alias("n")).where(F.col("n") <= AUTHORITY_RELEASES).select(key)


def _day() -> Column:
    return -F.unix_date(F.to_date("day"))


def _id(kind: str) -> Column:
    s = F.lit
    return {"release": F.concat(s("release:"), "ok"), "s": F.concat(s("s"), "sk"), "p": F.concat(s("p"), "pk"), "c": F.concat(s("c"), "ck"), "r": F.concat(s("r"), "ok", s(":"), "ln"), "m": F.concat(s("m"), "ok")}[kind]


def _place(sec: int, key: Column, day: Column, order: Column) -> Column:
    return F.struct(day.alias("d"), order.alias("o"), F.lit(sec).alias("sec"), key.alias("key"), F.lit(0).cast("long").alias("sub"))


def nodes_of(spark: SparkSession, sf_dir: str, h: DataFrame) -> DataFrame:
    """The nodes of marked lines, with places for ordinals. Of a line's nodes only parties are met again, so only they are gathered, each kind by its own key."""
    s = F.lit
    facet = lambda role: F.create_map(s("involvement"), F.array(role))
    nil = F.from_json(s("{}"), FACETS)
    order = -F.col("ok")
    shape = lambda rows, at, id_, label, kind, refs, n, facets: rows.select(at.alias("node_ord"), id_.alias("id"), label.alias("label"), s(kind).alias("kind"), F.concat_ws(" ", s(kind), label).alias("summary"), refs.alias("releaseRefs"), facets.alias("facets"), F.array().cast(FACTS).alias("facts"), n.cast("long").alias("n_refs"))
    own = lambda rows, sec, key, id_, kind: shape(rows, _place(sec, key, _day(), order), id_, id_, kind, F.array(F.col("ok").cast("string")), s(1), nil)
    heads = h.where("o_first")
    out = own(heads, 1, F.col("ok"), _id("release"), "release").unionByName(own(h, 5, F.col("ln"), _id("r"), "risk")).unionByName(own(heads, 6, F.col("ok"), _id("m"), "matter"))
    for sec, x, key, first, kind, who, facets in (
        (2, "s", "sk", "s_first", "organization", ("supplier", "s_suppkey", "s_name"), facet(F.when(F.col("sk") % 10 == 0, "authority").otherwise("related"))),
        (3, "p", "pk", "p_first", "instrument", ("part", "p_partkey", "p_name"), facet(s("related"))),
        (4, "c", "ck", "o_first", "person", ("customer", "c_custkey", "c_name"), facet(s("subject"))),
    ):
        met = h.where(first).groupBy(key).agg(
            F.min(F.struct(_day().alias("d"), order.alias("o"))).alias("at"), F.count(s(1)).alias("n"),
            F.transform(F.array_sort(F.collect_set(F.struct(_day().alias("d"), order.alias("o")))), lambda x: (-x["o"]).cast("string")).alias("refs"),
        )
        names = table(spark, sf_dir, who[0]).select(F.col(who[1]).alias(key), F.col(who[2]).alias("name"))
        out = out.unionByName(shape(met.join(names, key, "left"), _place(sec, F.col(key), F.col("at.d"), F.col("at.o")), _id(x), F.coalesce("name", _id(x)), kind, F.col("refs"), F.col("n"), facets))
    return out


def links_of(h: DataFrame) -> DataFrame:
    """The links of marked lines, with places for ordinals. Only suppliers' links to parts come again in other orders."""
    s = F.lit
    order, nil = -F.col("ok"), F.from_json(s("{}"), FACETS)

    def link(rows, sec, x, y, kind, family, day=None, order=order, key=F.col("ln")):
        return rows.select(_place(sec, key, _day() if day is None else day, order).alias("link_ord"), _id(x).alias("source"), _id(y).alias("target"), s(kind).alias("kind"), s(family).alias("family"), F.concat_ws(" ", _id(x), s(kind), _id(y)).alias("evidence"), (-order).cast("string").alias("releaseRef"), nil.alias("facets"), F.array().cast(FACTS).alias("facts"))

    issued = h.groupBy("sk", "pk").agg(F.min(F.struct(_day().alias("d"), order.alias("o"), "ln")).alias("at"))
    out = link(issued, 9, "s", "p", "issuer_of", "relationship", F.col("at.d"), F.col("at.o"), F.col("at.ln"))
    for x in (
        link(h.where("s_first"), 1, "release", "s", "mentions", "evidence"), link(h.where("p_first"), 2, "release", "p", "mentions", "evidence"), link(h.where("o_first"), 3, "release", "c", "primary_mention", "evidence"), link(h, 4, "release", "r", "asserts", "evidence"), link(h.where("o_first"), 5, "release", "m", "reports", "evidence"),
        link(h, 6, "c", "r", "subject_of", "participation"), link(h, 7, "s", "r", "authority_for", "participation"), link(h, 8, "r", "m", "belongs_to", "participation"),
    ):
        out = out.unionByName(x)
    return out


def marked(rows: DataFrame) -> DataFrame:
    """Lines with marks for the first of their order, of its supplier and of its part in the order. The first of an order has the numbers of all its lines."""
    by = lambda *keys: Window.partitionBy("ok", *keys).orderBy("ln")
    first = lambda *keys: F.row_number().over(by(*keys)) == 1
    every = F.collect_list("ln").over(by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({"o_first": first(), "lns": every, "s_first": first("sk"), "p_first": first("pk")})
    return rows.withColumn("lns", F.when(F.col("o_first"), F.col("lns")))


def placed_graph(spark: SparkSession, sf_dir: str, size: Size = ALL) -> PlacedGraph:
    """The graph of many lines: only the lines are written, once, and what a query reads is worked out from them."""
    h = cut(marked(lines(spark, sf_dir, *size)))
    rel = h.where("o_first").select(F.struct(_day().alias("d"), (-F.col("ok")).alias("o")).alias("release_ord"), F.col("ok").cast("string").alias("ref"), F.col("prio").alias("title"), F.col("day").alias("issueDate"), F.concat(F.lit("https://example.org/"), F.col("ok").cast("string")).alias("url"))
    return PlacedGraph(nodes_of(spark, sf_dir, h), links_of(h), rel, spark, sf_dir, h)
