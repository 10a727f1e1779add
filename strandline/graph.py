"""The evidence graph: nodes, links and releases as DataFrames with explicit order.

Schemas: nodes (node_ord, id, label, kind, summary, releaseRefs, facets,
facts), links (link_ord, source, target, kind, family, evidence, releaseRef,
facets, facts), releases (release_ord, ref, title, issueDate, url). Order is
part of the meaning: ties and caps follow node_ord, link_ord and release_ord.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the data model.
NODE_KINDS = ("release", "person", "organization", "fund", "group", "instrument", "unknown", "matter", "risk", "action")
NODE_FAMILIES = {"release": "source", "matter": "matter", "risk": "risk", "action": "action"}
EDGE_FAMILIES = ("evidence", "participation", "relationship")
PEOPLE = ("person", "group")
AUTHORITY_RELEASES = 10
HUB_DEGREE = 40

FACTS = "array<struct<name:string,value:string,evidence:string,releaseRef:string>>"
FACETS = "map<string,array<string>>"


def node_family(kind: Column) -> Column:
    """Family of a node kind: the source, a matter, risk or action, else an entity."""
    out = F.lit("entity")
    for k, family in NODE_FAMILIES.items():
        out = F.when(kind == k, family).otherwise(out)
    return out


def involvement(facets: Column) -> Column:
    return F.coalesce(facets["involvement"], F.array().cast("array<string>"))


def is_authority(facets: Column, release_refs: Column) -> Column:
    """Named as an authority, or in more than ten releases, and nowhere a subject."""
    roles = involvement(facets)
    return ~F.array_contains(roles, "subject") & (F.array_contains(roles, "authority") | (F.size(release_refs) > AUTHORITY_RELEASES))


def is_hub(degree: Column, authority: Column) -> Column:
    """A node that bounded traversals do not enter."""
    return (degree > HUB_DEGREE) | authority


@dataclass(frozen=True)
class EvidenceGraph:
    nodes: DataFrame
    links: DataFrame
    releases: DataFrame

    def flagged(self) -> DataFrame:
        """Nodes with their authority flag."""
        return self.nodes.withColumn("authority", is_authority(F.col("facets"), F.col("releaseRefs")))

    def topology(self) -> DataFrame:
        """Simple undirected edges (a < b): links outside the evidence family between nodes that are neither releases nor authorities."""
        eligible = self.flagged().where((F.col("kind") != "release") & ~F.col("authority")).select("id")
        pairs = self.links.where((F.col("family") != "evidence") & (F.col("source") != F.col("target")))
        pairs = pairs.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
        return pairs.join(eligible.withColumnRenamed("id", "a"), "a", "left_semi").join(eligible.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")

    def ends(self, kinds: Sequence[str]) -> DataFrame:
        """src, dst of the topology's edges in both directions, from nodes of the kinds."""
        edges = self.topology()
        ways = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
        return ways.join(self.nodes.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("src")), "src", "left_semi")

    def dense(self, found: DataFrame, name: str) -> DataFrame:
        """``found`` with ordinals in column ``name``, which this graph has already."""
        return found

    def adjacency(self) -> DataFrame:
        """Both directions of every link outside the evidence family: src, dst, link_ord."""
        links = self.links.where(F.col("family") != "evidence").select(F.col("source").alias("src"), F.col("target").alias("dst"), "link_ord")
        return links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "link_ord"))

    def validate(self) -> tuple[DataFrame, DataFrame]:
        """Node ids given more than once, and links with an end that is no node."""
        twice = self.nodes.groupBy("id").count().where("count > 1").select("id")
        ids = self.nodes.select("id").distinct()
        no_source = self.links.join(ids, F.col("source") == F.col("id"), "left_anti")
        no_target = self.links.join(ids, F.col("target") == F.col("id"), "left_anti")
        return twice, no_source.unionByName(no_target).dropDuplicates(["link_ord"])
