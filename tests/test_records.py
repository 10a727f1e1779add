import json
from datetime import date, datetime
from decimal import Decimal

import pytest

from strandline.operators.current import current_rows
from strandline.operators.orphans import find_orphans, orphan_counts, probed, slices
from strandline.operators.shred import entities, entity_table, parse_record, shred
from strandline.operators.skew import lookup_join
from strandline.operators.widen import long_cells, widen

KEYS = ("source_ref", "language")
REC = {"mentions": [{"id": "m1", "aliases": ["a", "b"], "attributes": {"name": "age", "value": 3}, "evidence": "plain"}, None, {"id": "m2", "attributes": [None, {"name": "x"}], "evidence": {"quote": "q"}}], "risks": {"id": "r1", "period": {"text": "t", "evidence": {"quote": "pq"}}}, "notes": [{"mentions": [{}]}], "actions": None}
CASES = [("mentions", 0, -1), ("mentions", 2, -1), ("mentions.attributes", 0, 0), ("mentions.attributes", 2, 1), ("risks", 0, -1)]


def found(spark, texts):
    df = spark.createDataFrame([(f"r{i}", None if i == 1 else "EN", t, "clash", i) for i, t in enumerate(texts)], "source_ref string, language string, extraction_json string, node string, ordinal int")
    nodes = shred(df, KEYS, "extraction_json")
    out = {}
    for r in entities(nodes, KEYS).collect():
        out.setdefault(r["source_ref"], []).append((r["path"], r["item_pos"], r["child_pos"]))
    return {k: sorted(v) for k, v in out.items()}


def test_shred_finds_objects_however_wrapped(spark):
    plain = json.dumps(REC)
    texts = [plain, json.dumps(plain), json.dumps({"data": REC}), json.dumps({"a": {"b": json.dumps(REC)}}), f"```json\n{plain}\n```", json.dumps([REC]), plain[:-3], None, "", "[]", "3", json.dumps({"x": 1})]
    got = found(spark, texts)
    assert got == {f"r{i}": CASES for i in range(6)}


def test_shred_deep_and_long():
    assert parse_record("[" * 100_000) is None
    deep = {"mentions": [{"id": "m", "x": "y" * 1_000_000}]}
    assert parse_record(json.dumps(deep)) == deep


def test_entity_table_pivots_scalars_lists_and_embedded_objects(spark):
    df = spark.createDataFrame([("r", "EN", json.dumps(REC))], "source_ref string, language string, extraction_json string")
    nodes = shred(df, KEYS, "extraction_json")
    rows = entity_table(nodes, KEYS, "mentions", ("id",), ("aliases",), ("evidence.quote",)).orderBy("item_pos").collect()
    assert [(r["item_pos"], r["id"], r["aliases"], r["evidence_quote"]) for r in rows] == [(0, "m1", ["a", "b"], "plain"), (2, "m2", [], "q")]
    risk = entity_table(nodes, KEYS, "risks", ("id",), (), ("period.text", "period.evidence.quote", "evidence.quote")).first()
    assert (risk["period_text"], risk["period_evidence_quote"], risk["evidence_quote"]) == ("t", "pq", None)
    named = shred(spark.createDataFrame([("r", "EN", json.dumps({"risks": [{"label": "l", "parent": "p", "ordinal": 3, "entity": "e", "kind": "k", "node": True}]}))], "source_ref string, language string, extraction_json string"), KEYS, "extraction_json")
    clash = entity_table(named, KEYS, "risks", ("label", "parent", "ordinal", "entity", "kind", "node")).first()
    assert tuple(clash)[2:] == (0, -1, "l", "p", "3", "e", "k", "true")
    attrs = entity_table(nodes, KEYS, "mentions.attributes", ("name", "value"), (), ()).orderBy("item_pos").collect()
    assert [(r["item_pos"], r["child_pos"], r["name"], r["value"]) for r in attrs] == [(0, 0, "age", "3"), (2, 1, "x", None)]


def test_current_rows_ties_nulls_and_copies(spark):
    rows = [("a", "1", "x"), ("a", "2", "y"), ("a", "2", "y"), ("a", None, "z"), (None, "1", "n"), ("b", None, "only")]
    df = spark.createDataFrame(rows, "k string, t string, v string")
    got = {(r["k"], r["t"], r["v"]) for r in current_rows(df, ("k",), ("t",), ("v",)).collect()}
    assert got == {("a", "2", "y"), (None, "1", "n"), ("b", None, "only")}
    tie = spark.createDataFrame([("a", "1", "x"), ("a", "1", "y")], "k string, t string, v string")
    assert current_rows(tie, ("k",), ("t",), ("v",)).count() == 1
    assert current_rows(df.limit(0), ("k",), ("t",), ("v",)).count() == 0


def test_orphans(spark):
    at = lambda d: datetime(2020, 1, d)
    links = spark.createDataFrame([(" 20pr1", "EN", "20PR2", at(5)), ("20PR1", "EN", "20PR2\n", at(3)), ("20PR1", "EN", "20PR3", at(5)), ("20PR1", "EN", "20PR9", None), ("20PR8", "EN", None, at(1)), ("20PR1", None, "20PR7", at(1))], "source_ref string, language string, target_ref string, recorded_at timestamp")
    releases = spark.createDataFrame([("20PR1", "EN", "2020-01-01T00:00:00Z"), ("20PR2", "EN", "2020-01-04T00:00:00+00:00"), ("20PR2", "ZH", "2020-01-01T00:00:00Z"), ("20PR5", "EN", "no time")], "source_ref string, language string, fetched_at string")
    removals = spark.createDataFrame([("20PR3", "EN"), ("20PR3", "EN"), (None, "EN")], "source_ref string, language string")
    rows = {tuple(r) for r in find_orphans(links, releases, removals).collect()}
    assert rows == {("target", "20PR1", "EN", "20PR2", "late", "2020-01"), ("target", "20PR1", "EN", "20PR3", "deleted", "2020-01"), ("target", "20PR1", "EN", "20PR9", "missing", None), ("source", "20PR8", "EN", None, "missing", "2020-01")}
    assert orphan_counts(find_orphans(links, releases, removals)).count() == 4
    assert find_orphans(links.limit(0), releases, removals).count() == 0
    assert {r["reason"] for r in find_orphans(links, releases.limit(0), removals).collect()} == {"missing", "deleted"}


def test_lookup_join_with_hot_key(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i int")
    right = df.select("k").distinct().selectExpr("k", "length(k) as n")
    got = lookup_join(df, right, ["k"], floor=10)
    assert sorted((r["i"], r["n"]) for r in got.collect()) == sorted((i, 3 if i % 3 else len(f"k{i}")) for i in range(300))


TYPES = [("age", "int"), ("profit", "decimal"), ("appointed_on", "date"), ("is_licensed", "boolean"), ("job_title", "string")]


def cells(spark, rows):
    df = spark.createDataFrame([("r", "EN", "m1", n, v, datetime(2020, 1, 1 + t) if t is not None else None, "clash") for n, v, t in rows], "source_ref string, language string, item_id string, name string, value string, recorded_at timestamp, age string")
    types = spark.createDataFrame(TYPES, "name string, value_type string")
    wide = widen(df, types)
    return wide, {(r["name"], r["cell_text"]) for r in long_cells(wide, types).collect()}


def test_widen_reads_types_and_resolves_corrections(spark):
    wide, got = cells(spark, [("Age", "aged 24", 1), ("age", "n/a", 5), (" AGE", "24.0", 0), ("profit", "HK$1.5 million", 1), ("Profit", "$2,393,987.50", 2), ("appointedOn", "1 May 2025", 1), ("appointed-on", "see notice", 3), ("isLicensed", "Y", 0), ("is licensed", None, 4), ("job_title", "  head of\n compliance ", 1), ("hobby", "golf", 1), (None, "x", 1)])
    assert got == {("age", "24"), ("profit", "2393987.5"), ("appointed_on", "2025-05-01"), ("is_licensed", "true"), ("job_title", "head of compliance")}
    row = wide.first()
    assert (row["age"], row["profit"].normalize(), row["appointed_on"], row["is_licensed"]) == (24, Decimal("2393987.5"), date(2025, 5, 1), True)


def test_widen_text_forms(spark):
    for name, value, text in (("profit", "96m", "96000000"), ("profit", "53.1 mn", "53100000"), ("profit", "HKD 7,422,021", "7422021"), ("profit", "4.1 per cent", "4.1"), ("profit", "27.40 %", "27.4"), ("profit", "1,185,709.00", "1185709"), ("profit", "100", "100"), ("age", "61 years old", "61"), ("age", "3,889 trades", "3889"), ("appointed_on", "20160505", "2016-05-05"), ("appointed_on", "May 23, 2020", "2020-05-23"), ("appointed_on", "2018-10-26T00:00:00", "2018-10-26"), ("appointed_on", "5 Nov 2019", "2019-11-05"), ("appointed_on", "2010/07/06", "2010-07-06"), ("appointed_on", "31 February 2020", None), ("is_licensed", "0", "false"), ("age", "unknown", None), ("age", "x" * 100_000, None)):
        assert cells(spark, [(name, value, 1)])[1] == ({(name, text)} if text else set()), value


def test_widen_ties_nulls_and_empty(spark):
    assert cells(spark, [("age", "3", 1), ("age", "5", 1), ("age", "5", 1)])[1] == {("age", "5")}
    assert cells(spark, [("age", "3", None), ("age", "4", 0)])[1] == {("age", "4")}
    wide, got = cells(spark, [("age", "n/a", 1)])
    assert wide.count() == 1 and not got
    assert cells(spark, [])[1] == set()


def test_bloom_filter_in_slices(spark):
    """More keys than one filter may hold: no key is ever denied, and few others pass."""
    assert (slices(0), slices(11_000_000), slices(12_000_000)) == (1, 1, 2)
    keys = spark.range(0, 2000).selectExpr("cast(id as string) as ref", "'EN' as language")
    refs = spark.range(0, 6000).selectExpr("cast(id as string) as ref", "'EN' as language")
    for bits in (1 << 27, 1 << 12):
        got = probed(refs, keys, ("ref", "language"), bits)
        assert got.count() == 6000
        maybe = {int(r["ref"]) for r in got.where("maybe").collect()}
        assert maybe >= set(range(2000)) and len(maybe) < 2000 + 0.05 * 4000
    assert probed(refs, keys.limit(0), ("ref", "language")).where("maybe").count() == 0


def test_too_many_columns_are_refused(spark):
    types = spark.range(0, 5001).selectExpr("concat('n', id) as name", "'string' as value_type")
    rows = spark.createDataFrame([("a", "EN", "i", "n1", "x", None)], "source_ref string, language string, item_id string, name string, value string, recorded_at timestamp")
    with pytest.raises(ValueError, match="5000"):
        widen(rows, types)
