"""Metrics of the graph of all lines, customer by customer.

A line's risk is tied to its order's matter, to the customer and, where that is
no authority, to the supplier. Without such a supplier a customer's orders meet
nothing else: customer, matters and risks are a component, and orders of as
many lines are alike in it. So an order is one row, no round joins edges, and
only customers (and orders without one) that have such a supplier are worked
out by the rounds of ``operators.metrics``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import metrics as M
from strandline.operators.skew import lookup_join
from strandline.plans.fixture import PlacedGraph
from strandline.session import cut


def _split(g: PlacedGraph) -> tuple[DataFrame, DataFrame | None]:
    """The orders (ok, ck, lns, k) of customers apart from all others; the edges of the others, None if there are none."""
    h = g.h.withColumn("_o", F.when(F.col("ck").isNull(), F.col("ok")))
    if g.suppliers.isEmpty():
        free, edges = h, None
    else:
        tied = cut(h.join(g.suppliers, "sk", "left_semi").select(F.col("ck").alias("_tc"), F.col("_o").alias("_to")).distinct())
        same = F.col("ck").eqNullSafe(F.col("_tc")) & F.col("_o").eqNullSafe(F.col("_to"))
        free, edges = h.join(tied, same, "left_anti"), cut(g.edges_of(h.join(tied, same, "left_semi")).select("a", "b"))
    return free.where("o_first").select("ok", "ck", "lns", F.size("lns").alias("k")), edges


def _ids(rows: DataFrame, customer: DataFrame, matter: list[Column], risk: list[Column]) -> DataFrame:
    """id and values of the matters and risks of ``rows`` (ok, lns), and of the customers."""
    names = [c for c in customer.columns if c != "ck"]
    value = lambda id_, of: F.struct(id_.alias("id"), *[c.alias(n) for n, c in zip(names, of)])
    risks = F.transform("lns", lambda ln: value(F.concat(F.lit("r"), "ok", F.lit(":"), ln), risk))
    out = rows.select(F.inline(F.concat(F.array(value(F.concat(F.lit("m"), "ok"), matter)), risks)))
    return out.unionByName(customer.select(F.concat(F.lit("c"), "ck").alias("id"), *names))


def components(g: PlacedGraph) -> DataFrame:
    """id, component, size. The smallest member is the customer, or the matter of an order without one."""
    orders, edges = _split(g)
    own, alone = orders.where("ck is not null"), orders.where("ck is null")
    name, at = F.concat(F.lit("c"), "ck"), [F.col("component"), F.col("size")]
    sizes = own.groupBy("ck").agg((F.sum(F.col("k") + 1) + 1).alias("size"))
    rows = lookup_join(own, sizes, ["ck"]).select("ok", "lns", name.alias("component"), "size")
    rows = rows.unionByName(alone.select("ok", "lns", F.concat(F.lit("m"), "ok").alias("component"), (F.col("k") + 1).cast("long").alias("size")))
    out = _ids(rows, sizes.select("ck", name.alias("component"), "size"), at, at)
    return out if edges is None else out.unionByName(M.components(edges))


def core_numbers(g: PlacedGraph) -> DataFrame:
    """id, core. Two lines of an order make a ring with its customer; all risks have two edges at most, so no core is beyond 2."""
    orders, edges = _split(g)
    ring = F.when(F.col("ck").isNotNull() & (F.col("k") > 1), 2).otherwise(1).cast("long")
    customers = orders.where("ck is not null").groupBy("ck").agg(F.max(ring).alias("core"))
    rows = orders.select("ok", "lns", ring.alias("core"))
    out = _ids(rows, customers, [F.col("core")], [F.col("core")])
    return out if edges is None else out.unionByName(M.core_numbers(edges))


def pagerank(g: PlacedGraph, rounds: int = M.ROUNDS, damping: float = M.DAMPING) -> DataFrame:
    """id, pagerank. A customer's orders of as many lines have the same ranks, so the rounds need one row per customer, and nothing moves between them."""
    orders, edges = _split(g)
    alike = orders.groupBy("ck", "k").agg(F.count(F.lit(1)).alias("n"))
    of = cut(alike.groupBy("ck").agg(F.collect_list(F.struct("k", "n")).alias("alike")))
    nodes = of.agg(F.sum(F.aggregate("alike", F.lit(0).cast("long"), lambda s, x: s + (x["k"] + 1) * x["n"]) + F.col("ck").isNotNull().cast("long"))).first()[0] or 0
    tied = 0 if edges is None else edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().count()

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield _ranks(part, nodes + tied, rounds, damping)

    ranks = cut(of.mapInArrow(run, f"ck {dict(of.dtypes)['ck']}, k int, c double, m double, r double"))
    rows = lookup_join(orders.where("ck is not null"), ranks.where("ck is not null").select("ck", "k", "m", "r"), ["ck", "k"])
    alone = orders.where("ck is null").join(F.broadcast(ranks.where("ck is null").select("k", "m", "r")), "k")
    rows = rows.select("ok", "lns", "m", "r").unionByName(alone.select("ok", "lns", "m", "r"))
    customers = ranks.where("ck is not null").groupBy("ck").agg(F.first("c").alias("pagerank"))
    out = _ids(rows, customers, [F.col("m")], [F.col("r")])
    return out if edges is None else out.unionByName(M.pagerank(edges, rounds, damping, nodes=nodes + tied))


def _ranks(part: pa.RecordBatch, nodes: int, rounds: int, damping: float) -> pa.RecordBatch:
    """ck, k and the ranks of the customer, the matter and a risk, for every customer and number of lines. Risks of orders without a customer have one edge."""
    ck, alike = part.column(0), part.column(1)
    sizes = np.diff(alike.offsets.to_numpy())
    who = np.repeat(np.arange(len(ck)), sizes)
    flat = alike.flatten()
    k, n = (flat.field(i).to_numpy().astype(float) for i in (0, 1))
    has = np.asarray(ck.is_valid())[who].astype(float)
    degree = np.maximum(np.bincount(who, n * k, len(ck)), 1)
    base = (1 - damping) / nodes
    c, m, r = np.full(len(ck), 1 / nodes), np.full(len(k), 1 / nodes), np.full(len(k), 1 / nodes)
    for _ in range(rounds):
        share = r / (1 + has)
        c, m, r = base + damping * np.bincount(who, n * k * share, len(ck)), base + damping * k * share, base + damping * (has * (c / degree)[who] + m / k)
    return pa.RecordBatch.from_arrays([ck.take(pa.array(who)), flat.field(0), pa.array(c[who]), pa.array(m), pa.array(r)], names=["ck", "k", "c", "m", "r"])
