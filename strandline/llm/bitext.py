"""Pairs of sentences that render the same statement in two languages.

No dictionary is given: the paired documents are one. Paired documents are
hashed to a fixed number of concepts; how a word (or a pair of Chinese
characters) of either language is spread over the concepts, against what its
frequency lets expect, is its vector, so words of both languages that occur in
the same pairs get like vectors. A pair's own words are judged by the other
pairs alone, else all its rare words would look alike. Every word of
``LEAST_PAIRS`` or more pairs has a vector: frequent words, of which there are
few, are broadcast; the others stay a table that is joined to the documents.

A sentence is cut into parts at strong breaks; a part is the sum of its words'
vectors. A sparse cosine join in SQL finds which parts belong together: the
``KEPT`` greatest entries of each part, and the numbers, dates and refs it
holds, meet on (document pair, entry), and products are summed. What reaches
``FLOOR`` is scored with whole vectors, as are merged windows of two or three
parts of a sentence, and whole sentences, around it. Parts for which this finds
no partner of a score of ``SURE`` are scored against all parts in full, so
that no pair is lost to the sparse join. Then mutual best spans are selected,
and grow over neighbouring parts, also of the next sentence, that have no
partner of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.current import current_rows
from strandline.session import cut

CONCEPTS = 256
KEPT = 32  # entries of a part's vector in the sparse join; None for all
FLOOR = 0.25  # of the sparse join's score
SURE = 0.7  # a score above which a part needs no further partners
BROADCAST_SHARE = 0.01  # of the document pairs hold a word that is broadcast; so at most 100 words per word of a mean document are
LEAST_PAIRS = 3
WINDOW = 3  # neighbouring parts that may be merged
GAIN = 0.15  # by which a window must beat the span that it grew from
BLOCK = 512  # parts scored in full at once
THRESHOLD = 0.3
SAME = 0.2  # for a shared number, date or ref, up to two
CLASH = 0.8  # where both have numbers (dates, refs) and share none

#: Strong breaks inside a sentence, after which another statement may begin.
EN_BREAKS = r";\s+(?:and\s+|but\s+)?|,\s+(?:and|while|whereas|but|meanwhile)\s+"
ZH_BREAKS = r"[；;]|，(?:另外|而且|而|同時|並且|至於|但)"

_BLOCKS = frozenset("p li ul ol div table tr td th h1 h2 h3 h4 h5 h6 section article blockquote".split())


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("style", "script"):
            self.hidden += 1
        elif tag in _BLOCKS:
            self.parts.append("\x1e")
        elif tag == "br":
            self.parts.append(" ")

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag in _BLOCKS:
            self.parts.append("\x1e")

    def handle_endtag(self, tag):
        if tag in ("style", "script"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in _BLOCKS:
            self.parts.append("\x1e")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data.replace("\x1e", " "))


def blocks(markup: str | None) -> list[str]:
    """Texts of the blocks in reading order; comments, style and script left out, white space made single."""
    if not markup:
        return []
    parser = _Text()
    parser.feed(markup)
    parser.close()
    return [b for b in (re.sub(r"\s+", " ", p).strip() for p in "".join(parser.parts).split("\x1e")) if b]


def sentences_en(markup: str | None) -> list[str]:
    """Sentences end at a full stop followed by white space, or with their block."""
    return [s for b in blocks(markup) for s in re.split(r"(?<=\.)\s+", b) if s]


def sentences_zh(markup: str | None) -> list[str]:
    """Sentences end at the ideographic full stop."""
    return [s for s in (p.strip() for p in re.split(r"(?<=。)", " ".join(blocks(markup)))) if s]


#: Months, number words and multiples of either language.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
DIGITS_ZH = {"〇": 0, "零": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
TIMES = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "千": 10**3, "萬": 10**4, "億": 10**8}

_MONTH = "|".join(MONTHS)
_EN_DATES = (re.compile(rf"\b(?P<d>\d{{1,2}}) (?P<m>{_MONTH}),? (?P<y>\d{{4}})", re.I), re.compile(rf"\b(?P<m>{_MONTH}) (?P<d>\d{{1,2}}), (?P<y>\d{{4}})", re.I))
_REF = re.compile(r"\d{2}PR\d+", re.I)
_EN_NUMBER = re.compile(r"(\d[\d,]*(?:\.\d+)?)(?: (thousand|million|billion)\b)?", re.I)
_EN_WORD = re.compile(r"\b(?:" + "|".join(NUMBER_WORDS[1:]) + r")\b", re.I)
_HAN_NUMBER = "[〇零一二兩三四五六七八九十]+"
_ZH_PART = re.compile(rf"({_HAN_NUMBER})(月|日|年(?=\d|{_HAN_NUMBER}月))")
_ZH_YEAR = re.compile(r"([〇零一二三四五六七八九]{4})年")
_ZH_DATE = re.compile(r"(\d{4})年(?:(\d{1,2})月(?:(\d{1,2})日)?)?")
_ZH_NUMBER = re.compile(r"(\d[\d,]*(?:\.\d+)?)([千萬億])?")
_ZH_COUNT = re.compile(rf"({_HAN_NUMBER})(?=[個星年名宗項月日])")


def _han(text: str) -> int:
    if "十" in text:
        tens, ones = text.split("十", 1)
        return (DIGITS_ZH.get(tens, 1) if tens else 1) * 10 + (DIGITS_ZH.get(ones, 0) if ones else 0)
    return int("".join(str(DIGITS_ZH[c]) for c in text))


def _value(digits: str, times: str | None) -> str:
    v = round(float(digits.replace(",", "") or 0) * TIMES.get((times or "").lower(), 1), 4)
    return f"n{v:g}" if v < 1e6 and v != int(v) else f"n{int(v) if v == int(v) else v}"


def anchors_en(text: str) -> tuple[set[str], str]:
    """Numbers, dates (also as month and as year) and refs, and the text with placeholders for them."""
    out: set[str] = set()

    def date(m):
        day = f"{m['y']}-{MONTHS.index(m['m'].lower()) + 1:02d}-{int(m['d']):02d}"
        out.update(("d" + day, "d" + day[:7], "d" + day[:4]))
        return " DDD "

    for pattern in _EN_DATES:
        text = pattern.sub(date, text)
    text = _REF.sub(lambda m: out.add("r" + m[0].upper()) or " RRR ", text)
    text = _EN_NUMBER.sub(lambda m: out.add(_value(m[1], m[2])) or " NNN ", text)
    text = _EN_WORD.sub(lambda m: out.add(f"n{NUMBER_WORDS.index(m[0].lower())}") or " NNN ", text)
    return out, text


def anchors_zh(text: str) -> tuple[set[str], str]:
    """The same in Chinese; a date counts as exact as it is given."""
    out: set[str] = set()
    text = _ZH_YEAR.sub(lambda m: f"{_han(m[1])}年", text)
    text = _ZH_PART.sub(lambda m: f"{_han(m[1])}{m[2]}", text)

    def date(m):
        out.add("d" + "-".join(x if i == 0 else f"{int(x):02d}" for i, x in enumerate(m.groups()) if x))
        return "Ｄ"

    text = _ZH_DATE.sub(date, text)
    text = _REF.sub(lambda m: out.add("r" + m[0].upper()) or "Ｒ", text)
    text = _ZH_NUMBER.sub(lambda m: out.add(_value(m[1], m[2])) or "Ｎ", text)
    text = _ZH_COUNT.sub(lambda m: out.add(f"n{_han(m[1])}") or "Ｎ", text)
    return out, text


def _grams_en(text: str) -> set[str]:
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", text)]
    return {*words, *(a + " " + b for a, b in zip(words, words[1:]))}


def _grams_zh(text: str) -> set[str]:
    return {run[i : i + n] for run in re.findall(r"[㐀-鿿ＤＲＮ]+", text) for n in (2, 3) for i in range(len(run) - n + 1)}


def _parts(text: str, breaks: str, size: int) -> list[str]:
    """Parts of a sentence between strong breaks, if all are long enough to state something."""
    found = [p for p in re.split(breaks, text) if p]
    return found if len(found) > 1 and min(map(len, found)) >= size else [text]


def parts(markup: str | None, side: str) -> list[tuple[int, set[str], set[str]]]:
    """(sentence number, word grams, anchors) of every part of every sentence, in reading order."""
    out = []
    chinese = side == "zh"
    for no, sentence in enumerate(sentences_zh(markup) if chinese else sentences_en(markup), 1):
        for p in _parts(sentence, ZH_BREAKS, 6) if chinese else _parts(sentence, EN_BREAKS, 20):
            anchors, text = anchors_zh(p) if chinese else anchors_en(p)
            out.append((no, _grams_zh(text) if chinese else _grams_en(text), anchors))
    return out


def _kinds(anchors: Iterable[str]) -> int:
    return sum(1 << i for i, k in enumerate("dnr") if any(a[0] == k for a in anchors))


def paired_documents(releases: DataFrame, left: str = "EN", right: str = "ZH") -> DataFrame:
    """source_ref, left and right html of every ref with a current release in both languages.

    The current release has the greatest modification_time, then fetched_at.
    A raw_json without readable html gives a null html.
    """
    rows = releases.where("source_ref is not null").withColumn("language", F.upper(F.trim("language"))).where(F.col("language").isin(left, right))
    now = current_rows(rows, ("source_ref", "language"), ("modification_time", "fetched_at"), ("raw_json",))
    now = now.select("source_ref", "language", F.get_json_object("raw_json", "$.html").alias("html"))
    one = now.where(F.col("language") == left).select("source_ref", F.col("html").alias("left_html"))
    return one.join(now.where(F.col("language") == right).select("source_ref", F.col("html").alias("right_html")), "source_ref")


_PART = pa.struct([("no", pa.int64()), ("words", pa.list_(pa.int32())), ("anchors", pa.list_(pa.string())), ("kinds", pa.int32())])
_DOCUMENT = pa.schema([("source_ref", pa.string()), ("en_words", pa.list_(pa.int64())), ("zh_words", pa.list_(pa.int64())), ("en_parts", pa.list_(_PART)), ("zh_parts", pa.list_(_PART))])
_PARTS = "array<struct<no:bigint,words:array<int>,anchors:array<string>,kinds:int>>"
_SCORED = pa.struct([("no", pa.int64()), ("anchors", pa.list_(pa.string())), ("kinds", pa.int32()), ("vector", pa.binary())])
_SCORED_DOCUMENT = pa.schema([("source_ref", pa.string()), ("en", pa.list_(_SCORED)), ("zh", pa.list_(_SCORED))])
_SCORED_PARTS = "array<struct<no:bigint,anchors:array<string>,kinds:int,vector:binary>>"


def _hashed(gram: str) -> int:
    return int.from_bytes(blake2b(gram.encode(), digest_size=8).digest(), "little", signed=True)


def _document(markup: str | None, side: str) -> tuple[list[int], list[dict]]:
    """The distinct hashed words of a document and its parts, which hold places in that list."""
    found = parts(markup, side)
    at = {g: i for i, g in enumerate(sorted({g for _, grams, _ in found for g in grams}))}
    return [_hashed(g) for g in at], [{"no": no, "words": sorted(at[g] for g in grams), "anchors": sorted(anchors), "kinds": _kinds(anchors)} for no, grams, anchors in found]


def all_parts(pairs: DataFrame) -> DataFrame:
    """source_ref, and of both documents of the pair the distinct hashed words and the parts; pairs with an empty side left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                rows = []
                for r in batch.slice(start, 200).to_pylist():
                    (en, en_parts), (zh, zh_parts) = _document(r["left_html"], "en"), _document(r["right_html"], "zh")
                    if en_parts and zh_parts:
                        rows.append({"source_ref": r["source_ref"], "en_words": en, "zh_words": zh, "en_parts": en_parts, "zh_parts": zh_parts})
                yield pa.RecordBatch.from_pylist(rows, schema=_DOCUMENT)

    return pairs.mapInArrow(run, f"source_ref string, en_words array<bigint>, zh_words array<bigint>, en_parts {_PARTS}, zh_parts {_PARTS}")


def _concept() -> Column:
    return F.pmod(F.xxhash64("source_ref"), F.lit(CONCEPTS)).cast("int")


def held_words(found: DataFrame) -> DataFrame:
    """source_ref, en (or zh), gram: every word of every pair once."""
    side = lambda s: found.select("source_ref", F.lit(s == "en").alias("en"), F.explode(f"{s}_words").alias("gram"))
    return side("en").unionByName(side("zh"))


def word_counts(held: DataFrame) -> DataFrame:
    """en, gram, df, ks, ns: of every word that ``LEAST_PAIRS`` or more pairs hold, the concepts and the number of pairs in each."""
    spread = held.groupBy("en", "gram", _concept().alias("k")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    words = spread.groupBy("en", "gram").agg(F.sum("n").alias("df"), F.collect_list(F.struct("k", "n")).alias("at")).where(F.col("df") >= LEAST_PAIRS)
    return words.select("en", "gram", "df", F.col("at.k").alias("ks"), F.col("at.n").alias("ns"))


def _dense(ks: pa.Array, ns: pa.Array) -> np.ndarray:
    """Counts over the concepts, one row per word."""
    out = np.zeros((len(ks), CONCEPTS), np.float32)
    rows = np.repeat(np.arange(len(ks)), np.diff(ks.offsets.to_numpy()))
    out[rows, ks.flatten().to_numpy()] = ns.flatten().to_numpy()
    return out


def _frequent(words: DataFrame) -> dict[bool, tuple[np.ndarray, np.ndarray]]:
    """Per side, the sorted words and their counts."""
    table = words.toArrow().combine_chunks()
    out = {}
    for en in (True, False):
        own = table.filter(pa.compute.equal(table["en"], en)).sort_by("gram").combine_chunks()
        ks, ns = (pa.concat_arrays(own[c].chunks) if own[c].num_chunks else pa.array([], pa.list_(pa.int32())) for c in ("ks", "ns"))
        out[en] = own["gram"].to_numpy(), _dense(ks, ns)
    return out


def _vectors(counts: np.ndarray, own: int, sizes: np.ndarray) -> np.ndarray:
    """Unit vectors of a pair's words, by what pairs other than this one (of concept ``own``) hold, times their rarity."""
    v, others = counts.copy(), sizes.copy()
    v[:, own] -= 1
    others[own] -= 1
    n, df = max(float(others.sum()), 1.0), v.sum(axis=1)
    v -= (df / n)[:, None] * others[None, :]
    norm = np.linalg.norm(v, axis=1)
    return v * np.where(norm > 1e-3, np.log((n + 1) / (df + 1)) / np.maximum(norm, 1e-3), 0.0).astype(np.float32)[:, None]


def with_vectors(found: DataFrame) -> DataFrame:
    """source_ref, en, zh: the parts of every document pair with their vectors (sums of word vectors, as 16-bit floats)."""
    sizes = np.zeros(CONCEPTS, np.float32)
    for r in found.groupBy(_concept().alias("k")).count().collect():
        sizes[r["k"]] = r["count"]
    held = held_words(found)
    words = cut(word_counts(held))
    often = F.col("df") >= BROADCAST_SHARE * float(sizes.sum())
    shared = found.sparkSession.sparkContext.broadcast(_frequent(words.where(often)))
    rare = held.join(words.where(~often), ["en", "gram"]).groupBy("source_ref").agg(F.collect_list(F.struct("en", "gram", "ks", "ns")).alias("rare"))
    whole = found.join(rare, "source_ref", "left").withColumn("own", _concept())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                own, sides = row["own"].as_py(), {}
                for en, s in ((True, "en"), (False, "zh")):
                    some, ids = row[f"{s}_parts"].as_py(), row[f"{s}_words"].values.to_numpy()
                    known, counts = frequent[en]
                    at = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
                    hit = known[at] == ids if len(known) else np.zeros(len(ids), bool)
                    place = np.full(len(ids), -1)
                    place[hit] = np.arange(hit.sum())
                    blocks_ = [counts[at[hit]]]
                    if row["rare"].is_valid:
                        values = row["rare"].values
                        mine = values.filter(pa.compute.equal(values.field("en"), en))
                        order = np.argsort(ids)
                        place[order[np.searchsorted(ids[order], mine.field("gram").to_numpy())]] = hit.sum() + np.arange(len(mine))
                        blocks_.append(_dense(mine.field("ks"), mine.field("ns")))
                    vectors = _vectors(np.concatenate(blocks_), own, sizes)
                    sides[s] = []
                    for p in some:
                        rows = place[p["words"]]
                        sides[s].append({"no": p["no"], "anchors": p["anchors"], "kinds": p["kinds"], "vector": vectors[rows[rows >= 0]].sum(axis=0).astype(np.float16).tobytes()})
                out.append({"source_ref": row["source_ref"].as_py(), **sides})
            yield pa.RecordBatch.from_pylist(out, schema=_SCORED_DOCUMENT)

    return whole.mapInArrow(run, f"source_ref string, en {_SCORED_PARTS}, zh {_SCORED_PARTS}")


def _matrix(some: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(p["vector"] for p in some), np.float16).reshape(len(some), CONCEPTS).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1)[:, None]
    return np.where(norm > 1e-6, rows / np.maximum(norm, 1e-6), 0.0).astype(np.float32)


def sparse_entries(scored: DataFrame, kept: int | None = KEPT) -> DataFrame:
    """source_ref, en, part, dims, weights: the greatest entries of every part's unit vector, and an entry for each number, date and ref."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ref, rows = batch.column("source_ref")[i].as_py(), []
                for s in ("en", "zh"):
                    some = batch.column(s)[i].as_py()
                    unit = _unit(_matrix(some))
                    most = CONCEPTS if kept is None else min(kept, CONCEPTS)
                    top = np.argpartition(-np.abs(unit), most - 1, axis=1)[:, :most]
                    for n, (p, ks, v) in enumerate(zip(some, top, unit)):
                        ks = np.sort(ks[v[ks] != 0])
                        # An entry of an anchor lies beyond the concepts; two that meet add SAME.
                        names = [CONCEPTS + (_hashed(a) & 0x7FFFFFFF) for a in p["anchors"]]
                        rows.append((ref, s == "en", n, [*ks.tolist(), *names], [*v[ks].tolist(), *([SAME**0.5] * len(names))]))
                types = (pa.string(), pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], ["source_ref", "en", "part", "dims", "weights"])

    return scored.mapInArrow(run, "source_ref string, en boolean, part int, dims array<bigint>, weights array<float>")


def sparse_cosines(entries: DataFrame) -> DataFrame:
    """source_ref, e, z, score of all parts of a document pair that share an entry: the sum of the products of what they share."""
    side = lambda en, name, w: entries.where(F.col("en") == en).select("source_ref", F.col("part").alias(name), F.inline(F.arrays_zip(F.col("dims").alias("dim"), F.col("weights").alias(w))))
    left, right = side(True, "e", "we"), side(False, "z", "wz")
    return left.join(right, ["source_ref", "dim"]).groupBy("source_ref", "e", "z").agg(F.sum(F.col("we") * F.col("wz")).alias("score"))


class _Side:
    """The spans of one document: parts, windows of neighbouring parts, and whole sentences; each a range of parts."""

    def __init__(self, some: list[dict]):
        self.no = [p["no"] for p in some]
        n = len(some)
        sentences_ = {}
        for i, no in enumerate(self.no):
            first, _ = sentences_.get(no, (i, i))
            sentences_[no] = (first, i)
        spans_ = [(i, i) for i in range(n)] + [(i, i + w - 1) for w in range(2, WINDOW + 1) for i in range(n - w + 1)]
        spans_ += [s for s in sentences_.values() if s[1] - s[0] >= WINDOW]
        self.spans = spans_
        self.place = {s: k for k, s in enumerate(spans_)}
        self.first_no = np.array([self.no[a] for a, _ in spans_])
        self.across = np.array([self.no[a] != self.no[b] for a, b in spans_])
        sums = np.concatenate((np.zeros((1, CONCEPTS), np.float32), np.cumsum(_matrix(some), axis=0, dtype=np.float64)))
        first, last = np.array(spans_).T
        self.unit = _unit(sums[last + 1] - sums[first])
        self.anchors = [frozenset(a for p in some[a : b + 1] for a in p["anchors"]) for a, b in spans_]
        self.kinds = np.array([_kinds(x) for x in self.anchors])
        self.around: list[list[int]] = [[] for _ in range(n)]
        for k, (a, b) in enumerate(spans_):
            for i in range(a, b + 1):
                self.around[i].append(k)


def scores(en: _Side, zh: _Side, es: np.ndarray, zs: np.ndarray) -> np.ndarray:
    """Scores of pairs of spans with whole vectors: the cosine, with what numbers, dates and refs say."""
    out = np.empty(len(es))
    for i in range(0, len(es), 4096):
        out[i : i + 4096] = np.einsum("ij,ij->i", en.unit[es[i : i + 4096]], zh.unit[zs[i : i + 4096]])
    for i in np.flatnonzero((en.kinds[es] & zh.kinds[zs]) != 0):
        both = en.anchors[es[i]] & zh.anchors[zs[i]]
        agreed = _kinds(both)
        out[i] += SAME * min(len(both), 2) - CLASH * (en.kinds[es[i]] & zh.kinds[zs[i]] & ~agreed != 0)
    return out


def _spans_around(en: _Side, zh: _Side, pairs: Iterable[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of spans within sentences about pairs of parts."""
    out = {(k, m) for e, z in pairs for k in en.around[e] if not en.across[k] for m in zh.around[z] if not zh.across[m]}
    ks = np.array(sorted(out), dtype=np.int64).reshape(-1, 2)
    return ks[:, 0], ks[:, 1]


def _in_full(en: _Side, zh: _Side, left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[np.ndarray, ...]]:
    """All pairs of these parts that reach the threshold, in blocks."""
    found = []
    for start in range(0, len(left) if len(right) else 0, BLOCK):
        es, zs = (x.ravel() for x in np.meshgrid(left[start : start + BLOCK], right, indexing="ij"))
        score = scores(en, zh, es, zs)
        good = score >= threshold
        found.append((es[good], zs[good], score[good]))
    return found


def select_spans(en: _Side, zh: _Side, candidates: list[tuple[int, int]], threshold: float) -> set[tuple[int, int]]:
    """(en_no, zh_no) of mutual best spans of a document pair, taken in turn, each part once.

    Parts without a sure candidate, and what is left, are scored in full. A
    span that was taken grows over a neighbouring part that nothing else took,
    in the next sentence too, where its partner is rendered by both better by
    ``GAIN`` than by itself.
    """
    free = {"en": np.ones(len(en.no), bool), "zh": np.ones(len(zh.no), bool)}
    taken: list[tuple[int, int, float]] = []

    def take(found: list[tuple[np.ndarray, ...]]) -> None:
        es, zs, score = (np.concatenate(x) for x in zip(*found))
        es, zs, score = (x[score >= threshold] for x in (es, zs, score))
        apart = np.abs(en.first_no[es] - zh.first_no[zs])
        for i in np.lexsort((zs, es, -(score - 0.001 * apart))):
            (a, b), (c, d) = en.spans[es[i]], zh.spans[zs[i]]
            if free["en"][a : b + 1].all() and free["zh"][c : d + 1].all():
                free["en"][a : b + 1] = free["zh"][c : d + 1] = False
                taken.append((es[i], zs[i], score[i]))

    es, zs = _spans_around(en, zh, candidates)
    found = [(es, zs, scores(en, zh, es, zs))]
    best_en, best_zh = np.full(len(en.spans), -1.0), np.full(len(zh.spans), -1.0)
    np.maximum.at(best_en, es, found[0][2])
    np.maximum.at(best_zh, zs, found[0][2])
    n, m = np.arange(len(en.no)), np.arange(len(zh.no))
    take(found + _in_full(en, zh, n[best_en[n] < SURE], m, threshold) + _in_full(en, zh, n[best_en[n] >= SURE], m[best_zh[m] < SURE], threshold))
    if left := _in_full(en, zh, np.flatnonzero(free["en"]), np.flatnonzero(free["zh"]), threshold):
        take(left)
    for at, (e, z, score) in enumerate(taken):
        for side, name in ((en, "en"), (zh, "zh")):
            (a, b) = side.spans[e if side is en else z]
            for c, d, more in ((a - 1, b, a - 1), (a, b + 1, b + 1)):
                k = side.place.get((c, d))
                if k is None or not free[name][more]:
                    continue
                wide, alone = ((k, z), (more, z)) if side is en else ((e, k), (e, more))
                grown, own = scores(en, zh, *np.array([wide, alone]).T)
                if grown >= score + GAIN and own >= threshold / 2:
                    free[name][more] = False
                    (e, z), score = wide, grown
                    taken[at] = (e, z, score)
                    break
    out = set()
    for e, z, _ in taken:
        (a, b), (c, d) = en.spans[e], zh.spans[z]
        out.update((x, y) for x in set(en.no[a : b + 1]) for y in set(zh.no[c : d + 1]))
    return out


def matched(found: DataFrame, threshold: float, kept: int | None = KEPT) -> DataFrame:
    """source_ref, en_no, zh_no of the sentences of every document pair that belong together."""
    scored = cut(with_vectors(found))
    near = sparse_cosines(sparse_entries(scored, kept)).where(F.col("score") >= FLOOR)
    lists = near.groupBy("source_ref").agg(F.array_sort(F.collect_list(F.struct("e", "z"))).alias("near"))
    whole = scored.join(lists, "source_ref", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, int]] = []
            for r in batch.to_pylist():
                picked = select_spans(_Side(r["en"]), _Side(r["zh"]), [(p["e"], p["z"]) for p in r["near"] or ()], threshold)
                out += [(r["source_ref"], *p) for p in sorted(picked)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["source_ref", "en_no", "zh_no"])

    return whole.mapInArrow(run, "source_ref string, en_no bigint, zh_no bigint")


def align(releases: DataFrame, threshold: float = THRESHOLD, kept: int | None = KEPT) -> DataFrame:
    """source_ref, en_no, zh_no of the sentences that render the same statement.

    ``releases``: source_ref, language, modification_time, fetched_at,
    raw_json. Refs in one language only, refs that are null, and documents
    without readable html or text give no pairs. Repeated rows count once;
    equal versions are settled as in ``current_rows``. Sentences are whole,
    and so are documents. Extra columns are ignored; an empty table gives no
    rows. With fewer than ``LEAST_PAIRS`` document pairs there is nothing to
    learn from and only shared numbers, dates and refs speak.
    """
    return matched(cut(all_parts(paired_documents(releases))), threshold, kept)
