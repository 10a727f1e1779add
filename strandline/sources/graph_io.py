"""Evidence graphs as JSON documents and as Parquet tables."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.graph import FACETS, FACTS, EvidenceGraph

NODE = f"node_ord bigint, id string, label string, kind string, summary string, releaseRefs array<string>, facets {FACETS}, facts {FACTS}"
LINK = f"link_ord bigint, source string, target string, kind string, family string, evidence string, releaseRef string, facets {FACETS}, facts {FACTS}"
RELEASE = "release_ord bigint, ref string, title string, issueDate string, url string"
PARTS = {"nodes": ("node_ord", NODE), "links": ("link_ord", LINK), "releases": ("release_ord", RELEASE)}


class InvalidGraph(ValueError):
    """A graph with repeated node ids, loose link ends or unsafe release addresses."""


def graph_json(graph: EvidenceGraph) -> str:
    """The whole graph as text: parts in order, indented by two, non-ASCII kept, a line break at the end. For graphs meant to be served from memory; tables go to Parquet."""
    out = {}
    for name, (order, _) in PARTS.items():
        rows = getattr(graph, name).orderBy(order).drop(order)
        out[name] = [json.loads(r["j"]) for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()]
    return json.dumps(out, ensure_ascii=False, indent=2) + "\n"


def write_graph(path: str | Path, text: str) -> None:
    """Write beside the target, then put it in its place; folders are made."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=path.name)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, path)


def is_current(path: str | Path, text: str) -> bool:
    """Whether the file holds just this text."""
    return Path(path).exists() and Path(path).read_text(encoding="utf-8") == text


def compact(value: object) -> str:
    """JSON without spaces, non-ASCII kept."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def read_graph(spark: SparkSession, path: str) -> EvidenceGraph:
    """A graph from its JSON document, checked."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    parts = {}
    for name, (order, schema) in PARTS.items():
        cols = [c.strip().split(" ")[0] for c in schema.split(", ")][1:]
        parts[name] = spark.createDataFrame([(i, *[row.get(c) for c in cols]) for i, row in enumerate(data[name])], schema)
    return checked(EvidenceGraph(**parts))


def unsafe_releases(releases: DataFrame) -> DataFrame:
    """Releases whose address is no http or https address."""
    scheme = F.lower(F.try_parse_url("url", F.lit("PROTOCOL")))
    return releases.where(~F.coalesce(scheme.isin("http", "https"), F.lit(False)))


def checked(graph: EvidenceGraph) -> EvidenceGraph:
    twice, loose = graph.validate()
    if not twice.isEmpty():
        raise InvalidGraph("node ids are given more than once")
    if not loose.isEmpty():
        raise InvalidGraph("links end at no node")
    if not unsafe_releases(graph.releases).isEmpty():
        raise InvalidGraph("release addresses must be http or https")
    return graph


def save_tables(graph: EvidenceGraph, folder: str) -> None:
    for name in PARTS:
        getattr(graph, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str) -> EvidenceGraph:
    return EvidenceGraph(*[spark.read.parquet(f"{folder}/{name}") for name in PARTS])
