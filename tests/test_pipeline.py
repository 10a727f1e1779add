import hashlib
import itertools
import json
import math
import re
import sys
import unicodedata
from datetime import datetime, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from strandline.functions.text import plain_text, release_links, title_label
from strandline.operators import ingest as I
from strandline.operators.evidence import check_quotes, first_missing_quote, ground, quotes, read_record, unknown_fields, unwrapped, violations
from strandline.operators.extract import ExtractionError, ExtractionRun, diagnostic, extract, saved
from strandline.operators import project as P
from strandline.operators.project import project, projection
from strandline.plans import pipeline
from strandline.session import ensure_checkpoint_dir
from strandline.sources.listing import HttpSource, SyncError, baseline_complete, sync, with_baseline
from strandline.streaming.budget import admitted, apply_budget, stream_budget
from strandline.streaming.incremental import ingest_stream, merge_batch, read_store


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # classes of this file go to the workers

PIECES = ("fish ", "&amp;", "&#x26; ", "&eacute;&nbsp;", "<p>", "</p>", "<BR/>", "<li class='a > b'>", "<td>", "</td>", "<!-- gone <p> -->", "<script>if (a < b) c = '&amp;';</script>", "<style>p {}</style>", "\n\t", "\u3000", "<!DOCTYPE html>", "<pre>", "1 < 2 ")


def parsed(markup):
    """The same by the standard parser, slowly."""
    from html.parser import HTMLParser

    out = []
    reader = HTMLParser(convert_charrefs=True)
    reader.handle_starttag = lambda tag, attrs: out.append(" ") if tag in ("br", "li", "p") else None
    reader.handle_data = out.append
    reader.feed(markup)
    reader.close()
    return re.sub(r"\s+", " ", "".join(out)).strip()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12))
def test_plain_text_is_what_a_parser_reads(pieces):
    markup = "".join(pieces)
    assert plain_text(markup) == parsed(markup)


def test_plain_text_of_nothing():
    assert plain_text(None) is None and plain_text("") == "" and plain_text("<td>left</td><td>right</td>") == "leftright"


def test_links_labels_and_quotes(spark):
    df = spark.createDataFrame([('<a href="x?refNo=25pr1"><a href="x?a=1&refNo=24PR2"><a href="?refNo=24PR2"><a href="?refNo=9PR9">', "25PR9", "public_reprimand")], "h string, r string, l string")
    row = df.select(release_links(F.col("h"), F.col("r")).alias("a"), title_label(F.col("l")).alias("l")).first()
    assert row["a"] == ["24PR2", "25PR1"] and row["l"] == "Public Reprimand"
    q = spark.createDataFrame([("the bank", "The Bank paid."), ("bank", "Bank and bank"), ("none", "other"), ("", "x"), (None, "x"), ("a.c", "abc A.C"), ("\\\\e[1]", "x \\\\E[1]"), ("İstanbul b", "in İSTANBUL B")], "quote string, source string")
    assert [(r["repaired"], r["grounded"]) for r in check_quotes(q).collect()] == [("The Bank", True), ("bank", True), ("none", False), ("", True), (None, None), ("A.C", True), ("\\\\E[1]", True), ("İSTANBUL B", True)]


RECORD = {
    "mentions": [
        {"id": "mention_1", "type": "person", "name": "Amy Poe", "aliases": ["A. Poe"], "relevance": "primary", "involvement": ["subject"], "description": "d", "geographies": [], "attributes": [{"name": "age", "value": "30", "evidence": {"quote": "q"}}], "evidence": {"quote": "q"}},
        {"id": "mention_2", "type": "organization", "name": "Board", "aliases": [], "relevance": "secondary", "involvement": ["authority"], "description": "e", "geographies": [], "attributes": [], "evidence": {"quote": "q"}},
    ],
    "matters": [{"id": "matter_1", "kind": "disciplinary_proceeding", "authority_ids": ["mention_2"], "subject_ids": ["mention_1"], "case_numbers": [], "legal_provisions": [], "description": "m", "evidence": {"quote": "q"}}],
    "relationships": [],
    "risks": [{"id": "risk_1", "matter_id": "matter_1", "authority_ids": [], "subject_ids": ["mention_1"], "affected_ids": [], "type": "fraud", "label": "L", "description": "r", "status": "found", "period": {"text": "2020"}, "geographies": [], "negated": False, "attributes": [], "evidence": {"quote": "q"}}],
    "actions": [{"id": "action_1", "matter_id": None, "actor_ids": ["mention_2"], "target_ids": ["mention_1"], "affected_ids": [], "type": "suspension", "label": "S", "description": "a", "status": "imposed", "amount": {"text": "$1", "amount": "1.00", "evidence": {"quote": "q"}}, "duration": "1 year", "period": None, "geographies": [], "attributes": [], "evidence": {"quote": "q"}}],
}


def rules(spark, record):
    df = spark.createDataFrame([(json.dumps(record),)], "j string").select(read_record(F.col("j")).alias("x"))
    return set(df.select(violations(F.col("x")).alias("v")).first()["v"])


def test_record_rules(spark):
    assert rules(spark, RECORD) == set()
    bad = json.loads(json.dumps(RECORD))
    bad["mentions"][0] |= {"relevance": "secondary", "id": "mention_x"}
    bad["risks"][0] |= {"type": "odd", "status": "odd", "matter_id": "matter_9", "period": {"text": "t", "start": "2021-01-02", "end": "2021-01-01"}, "label": "x" * 121}
    bad["actions"][0] |= {"type": "odd", "status": "odd", "target_ids": [], "amount": {"text": "t", "amount": "-1"}}
    bad["actions"].append(bad["actions"][0])
    assert rules(spark, bad) == {"primary_mention", "id_patterns", "mention_references", "risk_types", "claim_status", "matter_references", "period_order", "label_length", "action_types", "action_status", "targets_present", "amount_sign", "action_ids_unique", "evidence_present"}


def test_more_record_rules(spark):
    quote = {"quote": "q"}
    cases = [
        ("mention_types", lambda r: r["mentions"][0].update(type="robot")), ("relevance", lambda r: r["mentions"][1].update(relevance="tertiary")), ("involvement", lambda r: r["mentions"][0].update(involvement=["subject", "hero"])),
        ("involvement_present", lambda r: r["mentions"][0].update(involvement=[])), ("matter_kinds", lambda r: r["matters"][0].update(kind="quarrel")), ("qualifiers", lambda r: r["actions"][0]["amount"].update(qualifier="roughly")),
        ("currencies", lambda r: r["actions"][0]["amount"].update(currency="hkd")), ("terms", lambda r: r["mentions"][0]["attributes"][0].update(name="Age")), ("texts_present", lambda r: r["mentions"][0].update(description="  ")),
        ("evidence_present", lambda r: r["matters"][0].update(evidence={"quote": ""})), ("dates", lambda r: r["risks"][0]["period"].update(start="soon")), ("amounts", lambda r: r["actions"][0]["amount"].update(amount="lots")),
        ("relationship_kinds", lambda r: r["relationships"].append({"id": "relationship_1", "subject_id": "mention_1", "object_id": "mention_2", "kind": "feud", "predicate": "rival_of", "evidence": quote})),
        ("terms", lambda r: r["relationships"].append({"id": "relationship_1", "subject_id": "mention_1", "object_id": "mention_2", "kind": "other", "predicate": "Rival of", "evidence": quote})),
    ]
    for name, change in cases:
        record = json.loads(json.dumps(RECORD))
        change(record)
        assert rules(spark, record) == {name}, name


def test_unknown_fields_and_reading(spark):
    odd = json.loads(json.dumps(RECORD)) | {"extra": 1}
    odd["mentions"][0] |= {"colour": "red", "name": "  Amy Poe\u00a0"}
    odd["risks"][0]["period"]["zone"] = None
    df = spark.createDataFrame([(json.dumps(odd),), (json.dumps(json.dumps(RECORD)),), ("{",), (None,)], "j string")
    got = df.select(unknown_fields(unwrapped(F.col("j"))).alias("u"), read_record(F.col("j")).alias("x")).collect()
    assert [r["u"] for r in got] == [["extra", "mentions.colour", "risks.period.zone"], [], None, None]
    assert got[0]["x"]["mentions"][0]["name"] == "Amy Poe" and got[1]["x"]["risks"][0]["period"]["evidence"]["quote"] == "2020" and got[2]["x"] is None
    assert df.select(violations(read_record(F.col("j"))).alias("v")).collect()[2]["v"] == []


def test_grounding_of_whole_records(spark):
    record = json.loads(json.dumps(RECORD))
    record["mentions"][0]["evidence"]["quote"] = "AMY POE PAID"
    record["mentions"][0]["attributes"][0]["evidence"]["quote"] = "paid"
    record["risks"][0]["period"] = {"text": "in MAY", "start": "2020-05-01"}
    record["actions"][0]["period"] = {"text": "never said"}
    df = spark.createDataFrame([(json.dumps(record), "Amy Poe paid and paid in May q"), (json.dumps(RECORD), "no such text")], "j string, s string")
    rows = df.select(ground(read_record(F.col("j")), F.col("s")).alias("g"), "s").select("g", first_missing_quote(F.col("g"), F.col("s")).alias("m"), quotes(F.col("g")).alias("q")).collect()
    g = rows[0]["g"]
    assert g["mentions"][0]["evidence"]["quote"] == "Amy Poe paid" and g["mentions"][0]["attributes"][0]["evidence"]["quote"] == "paid"
    assert g["risks"][0]["period"]["evidence"]["quote"] == "in May" and g["actions"][0]["period"] is None and g["actions"][0]["duration"] == "1 year"
    assert rows[0]["m"] is None and rows[1]["m"] == "q" and len(rows[0]["q"]) == 8


def stub(doc):
    n = int(doc["reference"].split("PR")[1])
    if n == 1:
        try:
            raise KeyError("inner")
        except KeyError as error:
            raise ValueError("outer") from error
    mention = {"id": "mention_1", "type": "unknown", "name": "x", "relevance": "primary", "involvement": ["subject"], "description": "d", "evidence": {"quote": "BODY" if n == 2 else "absent" if n == 3 else "Title"}}
    return {"mentions": [mention if n != 4 else mention | {"odd": 1}], "risks": [] if n != 5 else [{"id": "risk_1"}]}, f"run{n}", {"requests": 1}


def test_extraction_run(spark):
    raw = lambda n: json.dumps({"newsRefNo": f"25PR{n}", "title": " Title ", "html": "<p>The body</p>", "issueDate": "2025-01-01"} if n != 6 else {"title": "no ref"})
    pending = spark.createDataFrame([(f"25PR{n}", "en", "m", raw(n)) for n in (1, 2, 3, 4, 5, 6, 2)], "source_ref string, language string, modification_time string, raw_json string")
    run = extract(pending, stub, 10, "some", workers=3)
    good = run.extractions.collect()
    assert [(r["source_ref"], r["language"], r["run_id"], json.loads(r["usage_json"]), json.loads(r["extraction_json"])["mentions"][0]["evidence"]["quote"]) for r in good] == [("25PR2", "EN", "run2", {"requests": 1}, "body")]
    bad = {r["source_ref"]: r for r in run.failures.collect()}
    assert {k: r["error_type"] for k, r in bad.items()} == {"25PR1": "ValueError", "25PR3": "EvidenceError", "25PR4": "InvalidRecord", "25PR5": "InvalidRecord", "25PR6": "ExtractionError"}
    assert bad["25PR1"]["error_message"] == "ValueError: outer\nCaused by: KeyError: 'inner'" and "absent" in bad["25PR3"]["error_message"] and "mentions.odd" in bad["25PR4"]["error_message"] and bad["25PR3"]["usage_json"] == '{"requests":1}'
    with pytest.raises(ExtractionError, match="5 extractions failed; the first is 25PR1") as caught:
        run.check()
    assert caught.value.run.extractions.count() == 1
    old_bad = run.failures.where("source_ref = '25PR3'").withColumn("source_ref", F.lit("25PR2"))
    done, failed = saved(run.extractions.limit(0), old_bad, run)
    assert done.count() == 1 and {r["source_ref"] for r in failed.collect()} == set(bad)
    assert saved(done, failed, ExtractionRun(run.extractions, run.failures.limit(0)))[0].count() == 1
    empty = extract(pending.limit(0), stub, 10, "some")
    assert empty.counts() == (0, 0) and empty.check() is None


def test_diagnostic_ends_in_a_ring():
    a, b = ValueError("a"), ValueError("b")
    a.__cause__, b.__cause__ = b, a
    assert diagnostic(a) == "ValueError: a\nCaused by: ValueError: b"


def test_projection(spark):
    raw = lambda t: json.dumps({"title": t})
    rows = [("25PR1", "2025-01-01", raw(" New "), json.dumps(RECORD)), ("24PR1", "2024-01-01", raw("Old"), json.dumps(RECORD)), ("23PR1", "2023-01-01", raw("Bad"), "{")]
    links = spark.createDataFrame([("24PR1", "EN", "25PR1"), ("24PR1", "EN", "20PR7"), ("99PR9", "EN", "25PR1"), ("24PR1", "ZH", "23PR1")], "source_ref string, language string, target_ref string")
    g = project(spark.createDataFrame(rows, "source_ref string, issue_date string, raw_json string, extraction_json string"), links, url="https://example.org/x/")
    nodes = {r["id"]: r for r in g.nodes.collect()}
    board = next(r for r in nodes.values() if r["label"] == "Board")
    assert board["id"].startswith("entity:organization:") and board["releaseRefs"] == ["25PR1", "24PR1"]
    amy = next(r for r in nodes.values() if r["label"] == "Amy Poe")
    assert [f["name"] for f in amy["facts"]] == ["description", "alias", "age"] * 2 and amy["facets"] == {"identity": ["exact_name"], "involvement": ["subject"]}
    act = nodes["action:25PR1:action_1"]
    assert act["facets"] == {"action_family": ["sanction"], "action_type": ["suspension"], "action_status": ["imposed"]} and [f["name"] for f in act["facts"]] == ["amount", "amount_normalized", "duration"]
    assert g.releases.where("ref = '25PR1'").first()["url"] == "https://example.org/x/25PR1"
    assert nodes["release:25PR1"]["label"] == "25PR1 · New" and "release:20PR7" in nodes and nodes["release:23PR1"]["node_ord"] > nodes["release:24PR1"]["node_ord"]
    kinds = [r["kind"] for r in g.links.orderBy("link_ord").collect()]
    assert kinds[:12] == ["primary_mention", "mentions", "reports", "authority_for", "subject_of", "asserts", "belongs_to", "subject_of", "reports", "actor_of", "target_of", "primary_mention"]
    assert kinds[-2:] == ["references", "references"]
    assert [r["ref"] for r in g.releases.orderBy("release_ord").collect()] == ["25PR1", "24PR1", "23PR1"]


def test_parts_of_a_projection_need_no_more_than_they_read(spark, monkeypatch):
    raw = lambda t: json.dumps({"title": t})
    rows = [(f"{y}PR1", f"20{y}-01-01", raw("t"), json.dumps(RECORD)) for y in range(10, 25)]
    current = spark.createDataFrame(rows, "source_ref string, issue_date string, raw_json string, extraction_json string")
    links = spark.createDataFrame([("24PR1", "EN", "20PR7")], "source_ref string, language string, target_ref string")
    read = lambda df: sorted(map(tuple, df.collect()))
    g = project(current, links)
    want = read(g.links.select("link_ord", "source", "target", "kind", "family")), read(g.topology()), read(g.nodes.where("node_ord < 9").select("node_ord", "id", "label", "kind"))
    monkeypatch.setattr(P, "merge", None)
    p, few = projection(current, links), projection(current, links, newest=2)
    assert read(p.links("source", "target", "kind", "family")) == want[0] and read(p.topology()) == want[1]
    assert read(few.labels().where("node_ord < 9")) == want[2] and few.releases.count() == 2


def test_projection_order_and_wrapped_records(spark):
    """Releases of one day come in falling order of their refs as texts, stubs in order of the links that name them."""
    one = {"mentions": [{"id": "mention_1", "type": "person", "name": "Amy Poe", "relevance": "primary", "involvement": ["subject"], "description": "d", "evidence": {"quote": "q"}}, {"id": "mention_2", "type": "fund", "name": "Sea Fund", "relevance": "secondary", "involvement": ["related"], "description": "d", "evidence": {"quote": "q"}}], "relationships": [{"id": "relationship_1", "subject_id": "mention_1", "object_id": "mention_2", "kind": "ownership", "predicate": "owner_of", "negated": True, "period": {"text": "2020"}, "evidence": {"quote": "q"}}]}
    rows = [(ref, day, json.dumps({"title": ref}), json.dumps({"data": one}) if ref == "24PR9" else json.dumps(one)) for ref, day in (("24PR10", "2024-01-05T08:00"), ("24PR97", "2024-01-05T08:00"), ("24PR9", "2024-01-05T08:00"), ("24PR1", "2024-01-05T09:30"))]
    links = spark.createDataFrame([("24PR97", "EN", "20PR5"), ("24PR10", "EN", "20PR7"), ("24PR9", "EN", "20PR7")], "source_ref string, language string, target_ref string")
    g = project(spark.createDataFrame(rows, "source_ref string, issue_date string, raw_json string, extraction_json string"), links)
    assert [r["ref"] for r in g.releases.orderBy("release_ord").collect()] == ["24PR1", "24PR97", "24PR9", "24PR10"]
    nodes = [r["id"] for r in g.nodes.orderBy("node_ord").collect()]
    assert nodes[-2:] == ["release:20PR7", "release:20PR5"] and nodes[0] == "release:24PR1"
    owns = g.links.where("kind = 'owner_of'").orderBy("link_ord").collect()
    assert [r["releaseRef"] for r in owns] == ["24PR1", "24PR97", "24PR9", "24PR10"] and owns[0]["facets"] == {"relationship_kind": ["ownership"], "claim_status": ["reported"], "negated": ["true"]} and [f["name"] for f in owns[0]["facts"]] == ["period"]
    assert [(r["source"], r["target"]) for r in g.links.where("kind = 'references'").orderBy("link_ord").collect()] == [("release:24PR10", "release:20PR7"), ("release:24PR9", "release:20PR7"), ("release:24PR97", "release:20PR5")]


def test_entity_ids_of_all_names(spark, tmp_path):
    names = ["Gaëlle Okoniéré", "Gae\u0308lle Okonie\u0301re\u0301", "Josefine Rozzbürgin", "ＡＢＣ  Fund", "Ａbc fund", "Straße Holding", "STRASSE HOLDING", "Émile\u00a0Zola", "émile Zola", "\u9673大文", "Amy Poe", " Amy Poe"]
    rows = [(i, t, n) for i, (n, t) in enumerate((n, t) for n in names for t in ("person", "fund", "group"))]
    spark.createDataFrame(rows, "entity_id long, type string, name string").write.parquet(str(tmp_path / "entity_register.parquet"))

    def brute(kind, name):
        if kind == "group" or not name[:1].isupper():
            return "mention:16PR1:mention_1"
        norm = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", name).casefold()).strip()
        return f"entity:{kind}:{hashlib.sha256(f'{kind}\0{norm}'.encode()).hexdigest()[:16]}"

    want = {i: brute(t, n) for i, t, n in rows}
    assert want[0] == want[3] != want[1] and want[9] == want[12]
    assert {r["entity_id"]: r["id"] for r in pipeline.queries()["entity_ids_all"](spark, str(tmp_path)).collect()} == want
    plain = {i for i, _, n in rows if n.isascii()}
    assert {r["entity_id"]: r["id"] for r in pipeline.queries()["entity_ids"](spark, str(tmp_path)).collect()} == {i: want[i] for i in plain}


def test_upsert_and_changes(spark):
    old = spark.createDataFrame([("a", "EN", 1), ("b", "EN", 1)], "source_ref string, language string, v int")
    new = spark.createDataFrame([("b", "EN", 2), ("b", "EN", 2), ("c", "EN", 3)], "source_ref string, language string, v int")
    assert {tuple(r) for r in I.upsert(old, new, I.RELEASE).collect()} == {("a", "EN", 1), ("b", "EN", 2), ("c", "EN", 3)}
    assert I.upsert(old, new.limit(0), I.RELEASE).count() == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=60), st.integers(1, 4), st.integers(1, 5))
def test_budget_windows(gaps, limit, cuts):
    """Against one request at a time; the state carries over any cut of the requests."""
    times = list(itertools.accumulate(gaps))
    want, opened, used = [], 0, 0
    for t in times:
        if t - opened >= 1000:
            opened, used = t, 0
        if used < limit:
            used += 1
            want.append((True, 0))
        else:
            want.append((False, math.ceil((opened + 1000 - t) / 1000)))
    got, state = [], (0, 0)
    for part in np.array_split(np.array(times, dtype=np.int64), cuts):
        allowed, wait, *state = admitted(part, limit, 1000, *state)
        got += list(zip(allowed.tolist(), wait.tolist()))
    assert got == want


def test_budget(spark):
    at = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc)
    df = spark.createDataFrame([(u, i, at(t)) for u in (1, 2, None, 0) for i, t in enumerate((100, 200, 300, 1100))], "user_id long, event_id long, ts timestamp")
    got = {tuple(r) for r in apply_budget(df, limit=2, window_ms=1000).collect()}
    assert got == {(u, i, i != 2, int(i == 2)) for u in (1, 2, None, 0) for i in range(4)}
    assert apply_budget(df.limit(0)).count() == 0


class Archive:
    """An archive in memory. ``listed``: (ref, issue date, modification time) newest first; others stand between them."""

    def __init__(self, listed, size=None, spoil=(), total=None):
        self.items = [{"newsRefNo": r, "issueDate": i, "modificationTime": m, "newsType": "EF"} for r, i, m in listed]
        for place in range(0, len(self.items), 7):
            self.items.insert(place, {"newsType": "GN"})
        self.spoil, self.total, self.known = dict(spoil), total, {r: (i, m) for r, i, m in listed}

    def page(self, number, language):
        return {"items": self.items[number * 100 :][:100], "total": len(self.items) if self.total is None else self.total}

    def document(self, ref, language):
        i, m = self.known[ref]
        return {"newsRefNo": ref, "lang": language.lower(), "title": "t", "html": "h", "issueDate": i, "modificationTime": m} | self.spoil.get(ref, {})


LISTING = [(f"{n:03}PR", f"2024-{n:03}", "first") for n in range(230, 0, -1)]


def stored(spark, rows):
    return spark.createDataFrame([(r, "EN", i, m) for r, i, m in rows], "source_ref string, language string, issue_date string, modification_time string")


def test_sync_compares_the_whole_listing(spark):
    """Changes on the last of three pages are found, and everything else is left alone."""
    known = stored(spark, [(r, i, "older" if r in ("001PR", "115PR") else m) for r, i, m in LISTING[3:]])
    run = sync(spark, Archive(LISTING), known, "en", limit=None, baseline=True)
    assert run.counts == {"checked": 230, "added": 3, "updated": 2, "unchanged": 225} and run.baseline
    rows = {r["source_ref"]: r for r in run.releases.collect()}
    assert rows.keys() == {"230PR", "229PR", "228PR", "115PR", "001PR"} and rows["001PR"]["language"] == "EN" and json.loads(rows["001PR"]["raw_json"])["modificationTime"] == "first"


def test_sync_limits_and_baselines(spark):
    none = stored(spark, [])
    run = sync(spark, Archive(LISTING), none, limit=23)
    assert run.counts["added"] == 23 and not run.baseline and {r["source_ref"] for r in run.releases.collect()} == {r for r, _, _ in LISTING[:23]}
    with pytest.raises(SyncError, match="full"):
        sync(spark, Archive(LISTING), none, limit=None)
    assert sync(spark, Archive(LISTING[:5]), none, limit=None, full=True).baseline and not sync(spark, Archive(LISTING), none, limit=5, full=True).baseline
    assert sync(spark, Archive([]), none, limit=None, full=True).counts["checked"] == 0
    twice = [LISTING[0], LISTING[1], LISTING[0]]
    assert sync(spark, Archive(twice), none, limit=None, full=True).counts == {"checked": 3, "added": 2, "updated": 0, "unchanged": 1}
    state = with_baseline(with_baseline(spark.createDataFrame([], "language string, completed boolean"), "en", True), "ZH", False)
    assert baseline_complete(state, "EN") and not baseline_complete(state, "zh") and not baseline_complete(with_baseline(state, "EN", False), "EN")


def test_sync_stops_at_what_it_cannot_use(spark):
    none = stored(spark, [])
    for spoil in ({"lang": "zh"}, {"newsRefNo": "other"}, {"html": None}):
        with pytest.raises(SyncError, match="226PR") as caught:
            sync(spark, Archive(LISTING, spoil=[("226PR", spoil)]), none, limit=9, full=True)
        assert {r["source_ref"] for r in caught.value.run.releases.collect()} == {"230PR", "229PR", "228PR", "227PR"} and not caught.value.run.baseline
    for total in (None, "many", True):
        broken = Archive(LISTING)
        broken.page = lambda number, language, total=total: {"items": [], "total": total}
        with pytest.raises(SyncError, match="total"):
            sync(spark, broken, none, limit=None, full=True)
    nameless = Archive(LISTING[:4])
    nameless.items[2]["issueDate"] = ""
    with pytest.raises(SyncError, match="issueDate") as caught:
        sync(spark, nameless, none, limit=None, full=True)
    assert caught.value.run.counts["checked"] == 1


class Answer:
    def __init__(self, text):
        self.text = text

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self):
        return self.text.encode()


def test_http_source_attempts(monkeypatch):
    from urllib.error import HTTPError, URLError

    asked, waits = [], []

    def opener(answers):
        left = iter(answers)

        def run(request, timeout):
            asked.append((request.get_method(), request.full_url, request.data, timeout))
            answer = next(left)
            if isinstance(answer, Exception):
                raise answer
            return Answer(answer)

        return run

    http = lambda code: HTTPError("u", code, "m", None, None)
    source = lambda *answers: HttpSource("https://example.org/api", opener=opener(answers), sleep=waits.append)
    assert source(http(503), "not json", '{"a": 1}').page(2, "EN") == {"a": 1} and waits == [1.0, 2.0]
    method, url, body, timeout = asked[0]
    assert (method, url, timeout) == ("POST", "https://example.org/api/search", 20.0) and json.loads(body)["pageNo"] == 2 and json.loads(body)["pageSize"] == 100
    assert source(http(429), '{"b": 2}').document("25PR1", "ZH") == {"b": 2} and asked[-1][1] == "https://example.org/api/content?refNo=25PR1&lang=ZH"
    asked.clear()
    for answers, n in (((http(404),), 1), (("[]",), 1), ((URLError("x"), TimeoutError(), http(500)), 3)):
        with pytest.raises(SyncError):
            source(*answers).page(0, "EN")
        assert len(asked) == n
        asked.clear()
    with pytest.raises(ValueError):
        HttpSource("x", attempts=0)


def test_incremental_store(spark, tmp_path):
    schema = "source_ref string, language string, issue_date string, modification_time string, raw_json string, fetched_at string"
    body = lambda *refs: json.dumps({"html": "".join(f'<a href="?refNo={r}">' for r in refs)})
    store = str(tmp_path / "store")
    batches = [[(f"20PR{i}", "en", "d", "m1", body("20PR1", "19PR9"), "f") for i in range(40)], [("20PR1", "EN", "d", "m2", body("18PR8"), "f"), ("20PR99", "EN", "d", "m2", body(), "f")], []]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        ingest_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "ckpt")).awaitTermination(120)
    releases = {r["source_ref"]: r["modification_time"] for r in read_store(spark, store, "releases").collect()}
    assert len(releases) == 41 and releases["20PR1"] == "m2" and releases["20PR2"] == "m1"
    links = {tuple(r)[::2] for r in read_store(spark, store, "release_links").collect()}
    assert ("20PR1", "18PR8") in links and ("20PR1", "19PR9") not in links and len(links) == 39 * 2 + 1
    merge_batch(spark.createDataFrame([("20PR2", "EN", "d", "late", body(), "f")], schema), store, 0)  # a batch seen before
    assert read_store(spark, store, "releases").where("source_ref = '20PR2'").first()["modification_time"] == "m1"
    assert read_store(spark, str(tmp_path / "nowhere"), "releases").count() == 0


def test_stream_budget(spark, tmp_path):
    rows = [(1, i, datetime.fromtimestamp(i / 10, timezone.utc)) for i in range(5)]
    schema = "user_id long, event_id long, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = stream_budget(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), limit=3, window_ms=1000, idle_windows=None).writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["event_id"], r["allowed"]) for r in spark.table("admitted").collect()) == [(0, True), (1, True), (2, True), (3, False), (4, False)]


def test_failing_checkpoint_folder_on_a_cluster(spark):
    class Context:
        master = "spark://far:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    class Far:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="share"):
        ensure_checkpoint_dir(Far)
