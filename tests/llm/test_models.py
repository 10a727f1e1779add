import json
import random

import pytest

from strandline.llm.bitext import align, anchors_en, anchors_zh, sentences_en, sentences_zh
from strandline.llm.mixing import capped_mean, mean_for_rate, mix, poisson_steps, replicate
from strandline.llm.subjects import assign, composition, sentences, train
from strandline.llm.variants import NICKNAMES, Register, attach_variants, channel, short_forms, words


def test_poisson_inversion():
    assert poisson_steps(1.0, 2) == pytest.approx([0.36788, 0.73576], abs=1e-4)
    for rate, cap in ((0.3, 1), (0.9, 1), (1.7, 2), (3.9, 4), (0.0, 3)):
        assert capped_mean(mean_for_rate(rate, cap), cap) == pytest.approx(rate, abs=1e-9)
    assert mean_for_rate(2.0, 2) == float("inf") and mean_for_rate(1.0, 0) == 0


def test_mix_reaches_shares_within_caps(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(["word"] * rng.randint(1, 40)), "abc"[min(i % 7, 2)]) for i in range(700)] + [(None, "word", "a"), (900, None, "a"), (901, "", "b"), (902, "no source", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumnRenamed("x", "y")
    targets = spark.createDataFrame([("m", "a", 0.2, 3), ("m", "b", 0.1, 1), ("m", "c", 0.9, 1), ("m", "none", 0.1, 2), ("z", "a", 0.0, 2), ("z", "b", None, None)], "mix_name string, source string, target_share double, max_repeats int")
    chosen, shares = mix(df, targets)
    got = {(r["mix_name"], r["source"]): r for r in shares.collect()}
    assert got["m", "a"]["share"] == pytest.approx(0.2, abs=0.01) and got["m", "b"]["share"] == pytest.approx(0.1, abs=0.01)
    assert got["m", "c"]["share"] < 0.9 and got["m", "none"]["tokens"] == 0 and got["z", "a"]["uses"] == 0 and got["z", "b"]["uses"] == 0
    rows = chosen.collect()
    assert all(1 <= r["uses"] <= {"a": 3, "b": 1, "c": 1}[r["source"]] for r in rows)
    assert {r["doc_id"] for r in rows if r["source"] == "c"} >= {d[0] for d in docs if d[2] == "c"}
    assert sorted(map(tuple, mix(df.repartition(5), targets)[0].collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert replicate(chosen).count() == sum(r["uses"] for r in rows)
    assert mix(df.limit(0), targets)[0].count() == 0 and mix(df, targets.limit(0))[1].count() == 0


REGISTER = [(1, "person", "Edward Ellis Huldstrand"), (2, "person", "Edward Monkrey"), (3, "person", "Dzuen Faat Sier"), (4, "person", "Dzuen Faat Mei"), (5, "organization", "Szekvane Glacier Capital Management Group Plc"), (6, "organization", "Szekvane Glacier Futures Group Plc"), (7, "organization", "Harbour Straits Conduct Authority"), (8, "fund", "Szekmere Anchor Income Fund"), (9, "organization", "Parldask Anchor Asset Management (Asia) Limited"), (10, "person", "Josefine Rozzbürgin")]
SPELLINGS = [
    ("person", "HULDSTRAND, Edward", [], 1), ("person", "Ted Huldstrand", None, 1), ("person", "Mr E. Monkrey", [], 2), ("person", "Edwrad Monkrey", [], 2), ("person", "Faat Sier Dzuen", [], 3), ("person", "Grace Dzuen", ["Dzuen Faat Mei"], 4),
    ("person", "Faatsier Dzuen", [], 3), ("organization", "SGCM", ["Szekvane Glacier Capital Management Grp plc"], 5), ("organization", "Futures, Szekvane Glacier", [], 6), ("organization", "The Harbour Straits Cpnduct Authority", [], 7), ("organization", "HSCA", [], 7),
    ("fund", "Anchor Szekmere Income Fund", [], 8), ("organization", "Parldask Anchor Asset Mgmt Asia Ltd.", [], 9), ("organization", "ParldaskAnchor Asset Management", [], 9), ("person", "Ｊｏｓｅｆｉｎｅ Rozzbürgin", [], 10), ("person", "Josefine Rozzburgin", [], 10),
    ("person", "Edward Monkrey", [], None), ("person", "Edward Monkosz", [], None), ("organization", "Szekvane Glacier", [], None), ("organization", "Thramere Citadel Futures Limited", [], None), ("unknown", "a company secretary", [], None), ("fund", "Harbour Straits Conduct Authority", [], None), ("person", "", [], None), ("person", None, ["Edward Monkrey"], None), ("person", "x" * 20_000, [], None),
]


def test_variants(spark):
    rows = [(i, t, n, a, "clash") for i, (t, n, a, _) in enumerate(SPELLINGS)]
    df = spark.createDataFrame(rows + rows[:4] + [(None, "person", "Ted Huldstrand", None, "")], "mention_id long, type string, name string, aliases array<string>, entity_id string")
    register = spark.createDataFrame(REGISTER, "entity_id long, type string, name string")
    got = dict(tuple(r) for r in attach_variants(df, register).collect())
    assert got == {i: e for i, (*_, e) in enumerate(SPELLINGS) if e is not None}
    assert attach_variants(df.limit(0), register).count() == 0 and attach_variants(df, register.limit(0)).count() == 0


def test_candidates_lose_no_name():
    """Against scoring every name of the register, on spellings made by random slips, cuts and changes of order."""
    rng = random.Random(11)
    given, family, lead, trade = ["Edward", "Amelia", "Bartholomew", "Josephine"], ["Monkrey", "Huldstrand", "Tarvelle", "Monkray"], ["Anchor", "Glacier", "Compass"], ["Capital Management", "Futures", "Securities Investment", "Trust Company"]
    rows = [(i, "person", f"{g} {m}{f}", i % 7) for i, (g, m, f) in enumerate((g, m, f) for g in given for m in ("", "Ellis ") for f in family)]
    rows += [(100 + i, "organization", f"{a} {b}{t} {x}", i % 5) for i, (a, b, t, x) in enumerate((a, b, t, x) for a in lead for b in ("", "Szekvane ") for t in trade for x in ("Limited", "Group Plc", "(Asia) Limited"))]
    reg = Register(rows, {w: frozenset(n.split()) for w, n in NICKNAMES.items()})

    def changed(name):
        ws = name.split()
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(ws))
            k = rng.randrange(len(ws[i]) or 1)
            ws[i] = rng.choice([ws[i][:k] + ws[i][k + 1 :], ws[i][:k] + "x" + ws[i][k:], ws[i][:1], ws[i][:4], "".join(c for c in ws[i] if c not in "aeiou"), "", ws[i]]) or "x"
            if rng.random() < 0.3:
                ws = ws[1:] + ws[:1]
            if rng.random() < 0.2 and len(ws) > 1:
                ws = [ws[0] + ws[1], *ws[2:]]
            if rng.random() < 0.3:
                ws = ws[: rng.randint(1, len(ws))]
            ws = ws or ["x"]
        return " ".join(ws)

    near = 0
    for _ in range(1500):
        _, kind, name, _ = rng.choice(rows)
        form = words(changed(name))
        within = {n for n, (e, ws, person, _) in enumerate(reg.names) if (e < 100) == (kind == "person") and channel(form, ws, person, reg.words) <= 5.5}
        near += len(within)
        assert within <= reg.candidates(kind, form)
    assert near > 1000


def test_short_forms_are_learned(spark):
    family = [a + b for a in ("Monk", "Huld", "Tarv", "Drus", "Zwan", "Kess") for b in ("rey", "strand", "elle", "osz")]
    persons = [f"{('Yolanda', 'Quentin', 'Andrew', 'Oscar')[i % 4]} {f}" for i, f in enumerate(family)]
    rows = [("person", f"Yoli {f}") for f in family[::4]] + [("person", f"{family[1]}, Qunt")] + [("person", f"Grace {f}") for f in family] + [("organization", "Yoli Ltd"), ("person", ""), ("person", "x")]
    got = short_forms(spark.createDataFrame(rows, "type string, name string"), persons)
    assert got["yolanda"] == {"yoli"} and not {"quentin", "oscar"} & got.keys() and "andy" in got["andrew"]
    assert short_forms(spark.createDataFrame([], "type string, name string"), persons).keys() == short_forms(spark.createDataFrame(rows, "type string, name string"), []).keys()


EN = ["{a} was released on bail of ${n} million.", "The accounts of {n} clients were frozen on {d} May 20{y}.", "Auditors could not verify ${n},000 of receivables.", "The appeal by {a} was dismissed by the court.", "No identity check was made on {n}.5% of the new accounts.", "The case was adjourned to {d} June 20{y} for plea."]
ZH = ["{z}獲准以{n}00萬元保釋。", "{n}個客戶帳戶在20{y}年5月{d}日被凍結。", "核數師未能核實{n},000元的應收帳款。", "法院駁回{z}的上訴。", "在新開立的帳戶當中，有{n}.5%未經身分核實。", "案件押後至20{y}年6月{d}日答辯。"]


def test_sentences_and_anchors():
    assert sentences_en("<!-- a. b --><style>p. {}</style><p>One&nbsp;two.<br/>Three 1.5 four</p><ul><li>Five.</li></ul>") == ["One two.", "Three 1.5 four", "Five."]
    assert sentences_zh("<p>一。二<b>三</b>。</p><p>四</p>") == ["一。", "二三。", "四"]
    assert anchors_en("on 3 April 2019 and April 3, 2019 paid HK$37.5 million and nine, 16pr2")[0] == {"d2019-04-03", "d2019-04", "d2019", "n37500000", "n9", "r16PR2"}
    assert anchors_zh("於二〇一九年4月3日支付3750萬元，九星期，16PR2，2018年")[0] == {"d2019-04-03", "n37500000", "n9", "r16PR2", "d2018"}


def test_alignment_of_shuffled_and_merged_sentences(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for k in range(150):
        picks = rng.sample(range(6), 4)
        fill = {i: {"a": f"Amy Poe{k % 9}", "z": "王李張陳"[k % 4] + "明", "n": rng.randint(20, 99), "d": rng.randint(1, 28), "y": rng.randint(10, 25)} for i in picks}
        order = rng.sample(picks, 4)[:3]
        zh = [ZH[i].format(**fill[i]) for i in order]
        at = {i: j + 1 for j, i in enumerate(order)}
        if k % 3 == 0:
            zh = [zh[0][:-1] + "；" + zh[1], zh[2]]
            at = {order[0]: 1, order[1]: 1, order[2]: 2}
        en = [EN[i].format(**fill[i]) for i in picks]
        want |= {(f"R{k}", picks.index(i) + 1, j) for i, j in at.items()}
        for lang, items in (("EN", en), ("ZH", zh)):
            rows.append((f"R{k}", lang, "2020", "2020", json.dumps({"html": "<p>" + ("" if lang == "ZH" else " ").join(items) + "</p>"}), "x"))
    rows += [("R0", "EN", "2019", "2019", json.dumps({"html": "<p>Old.</p>"}), "x"), ("S", "EN", "1", "1", json.dumps({"html": "<p>Alone.</p>"}), "x"), ("T", "EN", "1", "1", "{", "x"), ("T", "ZH", "1", "1", None, "x"), (None, "ZH", "1", "1", "{}", "x"), ("U", "EN", "1", "1", '{"html": ""}', "x"), ("U", "ZH", "1", "1", '{"html": "<p>' + "長" * 50_000 + '</p>"}', "x")]
    df = spark.createDataFrame(rows + rows[:2], "source_ref string, language string, modification_time string, fetched_at string, raw_json string, en_no string")
    got = {tuple(r) for r in align(df).collect()}
    right = len(got & want)
    assert right / len(got) > 0.95 and right / len(want) > 0.85
    assert align(df.limit(0)).count() == 0


def test_alignment_by_rare_names(spark):
    """Names that 5 of 1,200 document pairs hold tell two statements of one template apart."""
    rng = random.Random(9)
    english = [a + b for a in ("Bram", "Cold", "Dun", "Fen", "Gor", "Hal", "Kes", "Lor", "Mar", "Nor", "Pel", "Ros", "Sel", "Tor", "Vel", "Wes") for b in ("ane", "beck", "croft", "dale", "ek", "ford", "gate", "holm", "ine", "kin", "ley", "mere", "ness", "oak", "pike")]
    chinese = [chr(0x5000 + 2 * i) + chr(0x7000 + 3 * i) for i in range(len(english))]
    deck = list(range(len(english))) * 5
    rng.shuffle(deck)
    rows, want = [], set()
    for k, (x, y) in enumerate(zip(deck[::2], deck[1::2])):
        en = [f"{english[i]} was found guilty of false trading." for i in (x, y)]
        zh = [f"{chinese[i]}被裁定虛假交易罪名成立。" for i in (y, x)]
        if x != y:
            want |= {(f"R{k}", 1, 2), (f"R{k}", 2, 1)}
        for lang, items in (("EN", en), ("ZH", zh)):
            rows.append((f"R{k}", lang, "2020", "2020", json.dumps({"html": "<p>" + " ".join(items) + "</p>"})))
        for lang, other in (("EN", "The hearing is public."), ("ZH", "聆訊公開進行。")):
            rows.append((f"S{k}", lang, "2020", "2020", json.dumps({"html": f"<p>{other}</p>"})))
    df = spark.createDataFrame(rows, "source_ref string, language string, modification_time string, fetched_at string, raw_json string")
    got = {tuple(r) for r in align(df).collect() if r["source_ref"][0] == "R"}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


def _statements(k, rng):
    """Two statements of a pair: (EN, ZH) of each, drawn from 12 templates with a number."""
    verbs = [("sold the shares", "出售股份"), ("opened an account", "開立帳戶"), ("signed the papers", "簽署文件"), ("left the board", "離開董事會"), ("paid the fee", "繳付費用"), ("moved the money", "轉移款項"), ("called the broker", "致電經紀"), ("wrote the report", "撰寫報告"), ("lost the licence", "失去牌照"), ("joined the fund", "加入基金"), ("hid the records", "隱藏紀錄"), ("met the auditor", "會見核數師")]
    return [(f"The manager {verbs[i][0]} without delay", f"經理立即{verbs[i][1]}") for i in rng.sample(range(12), 4)]


def _releases(spark, pairs):
    rows = [(ref, lang, "2020", "2020", json.dumps({"html": "<p>" + text + "</p>"})) for ref, en, zh in pairs for lang, text in (("EN", en), ("ZH", zh))]
    return spark.createDataFrame(rows, "source_ref string, language string, modification_time string, fetched_at string, raw_json string")


def test_alignment_merges_neighbouring_sentences(spark):
    """A ZH sentence that renders two EN sentences, joined by a plain comma, is paired with both."""
    rng = random.Random(4)
    pairs, want, merged = [], set(), set()
    for k in range(300):
        st = _statements(k, rng)
        en = [s[0] + "." for s in st]
        if k % 3:
            zh = [s[1] + "。" for s in st]
            want |= {(f"R{k}", i, i) for i in range(1, 5)}
        else:
            zh = [st[0][1] + "，" + st[1][1] + "。", st[2][1] + "。", st[3][1] + "。"]
            merged |= {(f"R{k}", 1, 1), (f"R{k}", 2, 1)}
            want |= {(f"R{k}", 3, 2), (f"R{k}", 4, 3)}
        pairs.append((f"R{k}", " ".join(en), "".join(zh)))
    df = _releases(spark, pairs)
    got = {tuple(r) for r in align(df).collect()}
    assert len(got & want) / len(want) > 0.97 and len(got & merged) / len(merged) > 0.85
    assert len(got - want - merged) / len(got) < 0.03
    # All entries in the sparse join instead of the greatest: the same pairs.
    whole = {tuple(r) for r in align(df, kept=None).collect()}
    assert len(got ^ whole) <= 0.01 * len(whole)


TOPICS = {"cats": ["the cat chased a mouse", "a kitten purred softly", "whiskers and paws", "the tabby slept"], "cars": ["the engine needs oil", "a gearbox was replaced", "brakes and tyres", "the sedan was parked"], "food": ["soup was served hot", "bread from the oven", "rice and beans", "the stew simmered"]}


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(7)
    docs, truth = [], {}
    for i in range(400):
        own = rng.sample(sorted(TOPICS), rng.choice((1, 1, 2)))
        body = [rng.choice(TOPICS[t]).capitalize() + "." for t in own for _ in range(4)] + ["The office is closed today."] * rng.randint(0, 2)
        rng.shuffle(body)
        docs.append((i, " ".join(body)))
        truth[i] = set(own)
    docs += [(1000, None), (1001, ""), (1002, "  "), (1003, "12 34."), (None, docs[0][1]), (1004, docs[0][1] + " The office is closed today." * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "length(text) as n_chars", "'x' as subject")
    labels = spark.createDataFrame([(i, t.upper() + " ") for i in range(0, 120) for t in sorted(truth[i])] + [(3, "unheard of"), (None, "cats")], "doc_id long, subject string")
    areas = spark.createDataFrame([(t, t.title(), None) for t in sorted(TOPICS)], "subject string, title string, description string")
    model = train(df, labels, areas)
    got = {}
    for r in assign(df, model).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = [i for i in range(120, 400)]
    assert sum(got.get(i, set()) == truth[i] for i in held) / len(held) > 0.9
    assert not got.keys() & {1000, 1001, 1002, 1003, 1004} and None in got
    total = {r["subject"]: r["documents"] for r in composition(df, assign(df, model)).collect()}
    assert total["none"] >= 5
    assert assign(df.limit(0), model).count() == 0 and train(df, labels.limit(0), areas).weights.any()
    assert sentences("<p>A b.</p> C d。E；f") == ["A b.", "C d。", "E;", "f"] or sentences(None) == []
