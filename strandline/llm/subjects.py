"""Subject areas of documents by one-versus-rest linear classifiers on hashed n-grams.

Labels say which areas a document deals with, not which sentence; they are
few, uneven and partly wrong. So they count as weak labels of the sentences:
the classifiers are fitted on them, each labelled sentence is then given to
the best-supported area of its document or to none, and the fit is repeated.
Titles and descriptions of the areas are weakly labelled sentences too. A
document gets an area if enough of its sentences are about it; how much is
enough is calibrated on labelled documents held out of the fit.

The fit is made on the driver, on the hashed n-grams of labelled documents
(whole texts) chosen by a hash of their id: at most about ``MAX_TRAIN_DOCS``
of them, and of at most ``MAX_TRAIN_SENTENCES`` sentences. It is the same fit
at every size. All documents are classified where they lie, whole and without
a shuffle.
"""

from __future__ import annotations

import re
import unicodedata as ud
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import cut, small_rows

#: Bounds of the fit: labelled documents, their sentences in all, and the width of the hash.
MAX_TRAIN_DOCS = 4_000
MAX_TRAIN_SENTENCES = 120_000
WIDTH = 1 << 17
ROUNDS = 4
STEPS = 12
HOLD_OUT = 5  # every fifth labelled document calibrates
SHARE = 0.25  # of a document's sentences makes an area, before calibration
PRIOR_CASES = 50  # held-out cases that SHARE counts as much as

_TAG = re.compile(r"<(?:style|script)\b.*?</(?:style|script)\s*>|<!--.*?-->|<[a-zA-Z/][^<>]*>", re.S | re.I)
_ENTITY = re.compile(r"&(?:nbsp|amp|lt|gt|quot|#\d+|#x[0-9a-fA-F]+);")
_END = re.compile(r"(?<=[.!?])[\"'”’)]*\s+|(?<=[。！？；])\s*|\n+")
_TOKEN = re.compile(r"[0-9][0-9,.]*|[㐀-䶿一-鿿豈-﫿]+|[^\W_0-9㐀-䶿一-鿿豈-﫿]+")
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, markup taken out; none of a null, empty or blank one."""
    if not text:
        return []
    text = _ENTITY.sub(" ", _TAG.sub(" ", text))
    text = ud.normalize("NFKC", text.replace("；", ";")).replace("\r", "\n")
    return [s for s in (p.strip() for p in _END.split(text)) if len(s) > 1 and any(c.isalpha() for c in s)]


_hashes: dict[str, int] = {}


def _hash(gram: str) -> int:
    h = _hashes.get(gram)
    if h is None:
        if len(_hashes) > 500_000:
            _hashes.clear()
        h = _hashes[gram] = zlib.crc32(gram.encode()) % WIDTH
    return h


def features(sentence: str) -> list[int]:
    """Hashed n-grams: words and pairs of words, pairs and triples of Chinese characters, numbers as one."""
    out: set[int] = set()
    before = ""
    folded = "".join(c for c in ud.normalize("NFD", sentence.casefold()) if not ud.combining(c) and ud.category(c) != "Cf")
    for token in _TOKEN.findall(folded):
        if _HAN.match(token):
            out.update(_hash(token[i : i + n]) for n in (2, 3) for i in range(len(token) - n + 1))
            before = ""
            continue
        if token[0].isdigit():
            token = "#"
        out.add(_hash(token))
        if before:
            out.add(_hash(before + " " + token))
        before = token
    return sorted(out)


@dataclass
class Grams:
    """The n-grams of some sentences one after another, and how many each has."""

    flat: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(lists: Iterable[Sequence[int]]) -> Grams:
        lists = [np.asarray(g, dtype=np.int32) for g in lists]
        return Grams(np.concatenate(lists) if lists else np.zeros(0, np.int32), np.array([len(g) for g in lists], dtype=np.int64))

    @staticmethod
    def joined(parts: Sequence[Grams]) -> Grams:
        return Grams(np.concatenate([p.flat for p in parts] or [np.zeros(0, np.int32)]), np.concatenate([p.lengths for p in parts] or [np.zeros(0, np.int64)]))

    def blocks(self, size: int = 8_192) -> Iterator[tuple[slice, Grams]]:
        ends = np.concatenate(([0], np.cumsum(self.lengths)))
        for i in range(0, len(self.lengths), size):
            j = min(i + size, len(self.lengths))
            yield slice(i, j), Grams(self.flat[ends[i] : ends[j]], self.lengths[i:j])


@dataclass
class Model:
    subjects: list[str]
    weights: np.ndarray  # WIDTH x areas
    bias: np.ndarray
    shares: np.ndarray  # share of a document's sentences that makes an area

    def scores(self, grams: Grams) -> np.ndarray:
        """Log-odds of every area for each sentence."""
        out = np.tile(self.bias, (len(grams.lengths), 1))
        for rows, part in grams.blocks():
            full = np.flatnonzero(part.lengths)
            if len(full):
                starts = np.concatenate(([0], np.cumsum(part.lengths[full])[:-1]))
                out[rows][full] += np.add.reduceat(self.weights[part.flat], starts, axis=0) / np.sqrt(part.lengths[full])[:, None]
        return out

    def about(self, grams: Grams) -> np.ndarray:
        """The area each sentence is about, -1 for none."""
        s = self.scores(grams)
        best = s.argmax(axis=1) if s.size else np.zeros(0, np.int64)
        return np.where(s[np.arange(len(s)), best] > 0, best, -1)


class _Block:
    """Some sentences made ready for steps of the fit: their n-grams' places among the active ones, by sentence and by n-gram."""

    def __init__(self, grams: Grams, active: np.ndarray):
        self.place = np.searchsorted(active, grams.flat).astype(np.int32)
        self.starts = np.concatenate(([0], np.cumsum(grams.lengths)[:-1]))
        self.value = (1 / np.sqrt(grams.lengths))[:, None].astype(np.float32)
        order = np.argsort(self.place, kind="stable")
        self.owner = np.repeat(np.arange(len(grams.lengths), dtype=np.int32), grams.lengths)[order]
        self.held, self.first = np.unique(self.place[order], return_index=True)


def _fit(blocks: list[tuple[slice, _Block]], targets: np.ndarray, use: np.ndarray, w: np.ndarray, b: np.ndarray) -> None:
    """One-versus-rest logistic regression by Adagrad on the whole batch, in place. ``use`` is 0 where a sentence says nothing of an area."""
    g2, h2 = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(STEPS):
        grad, slope = 1e-3 * w, np.zeros_like(b)
        for rows, block in blocks:
            logits = np.add.reduceat(w[block.place], block.starts, axis=0) * block.value + b
            error = (1 / (1 + np.exp(-logits)) - targets[rows]) * use[rows]
            grad[block.held] += np.add.reduceat((error * block.value)[block.owner], block.first, axis=0)
            slope += error.sum(axis=0)
        g2 += grad**2
        w -= 0.7 * grad / np.sqrt(g2)
        h2 += slope**2
        b -= 0.3 * slope / np.sqrt(h2)


def fit(docs: list[tuple[Grams, set[int]]], areas: list[tuple[str, Grams]]) -> Model:
    """Fit on documents (n-grams of each sentence, areas) and on each area's own description; every fifth document is held out for the thresholds."""
    subjects = [s for s, _ in areas]
    n = len(subjects)
    model = Model(subjects, *_learn([d for i, d in enumerate(docs) if (i + 1) % HOLD_OUT], areas, n), np.full(n, SHARE))
    model.shares = _calibrate(model, [d for i, d in enumerate(docs) if not (i + 1) % HOLD_OUT], n)
    return model


def _learn(train: list[tuple[Grams, set[int]]], areas: list[tuple[str, Grams]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias, by fitting and giving sentences to areas in turn."""
    sources = [(g, {a}) for a, (_, g) in enumerate(areas)] + train
    grams = Grams.joined([g for g, _ in sources])
    own = np.concatenate([np.tile(np.isin(np.arange(n), list(labels)).astype(np.float32), (len(g.lengths), 1)) for g, labels in sources] or [np.zeros((0, n), np.float32)])
    own, grams = own[grams.lengths > 0], Grams(grams.flat, grams.lengths[grams.lengths > 0])
    bias = np.full(n, -2.0, np.float32)
    full = np.zeros((WIDTH, n), np.float32)
    if not len(own):
        return full, bias
    active = np.unique(grams.flat)
    w = np.zeros((len(active), n), np.float32)
    blocks = [(rows, _Block(part, active)) for rows, part in grams.blocks()]
    targets, use = own / np.maximum(own.sum(axis=1, keepdims=True), 1), np.ones_like(own)
    for k in range(ROUNDS):
        _fit(blocks, targets, use, w, bias)
        full[active] = w
        if k == ROUNDS - 1:
            break
        s = Model([], full, bias, np.zeros(n)).scores(grams)
        p = 1 / (1 + np.exp(-s))
        best = np.where(own > 0, s, -np.inf).argmax(axis=1)
        within = np.zeros_like(own)
        within[np.arange(len(own)), best] = 1
        targets = within * own * (p > (0.3 if k == 0 else 0.5))
        # An area the document isn't labelled with, but the sentence surely is about, is a passing mention or a missing label.
        outside = (own == 0) & (p > 0.6)
        use = np.where(outside | ((own > 0) & (targets == 0) & (p > 0.3)), np.float32(0), np.float32(1))
    return full, bias


def shares_of(model: Model, grams: Grams) -> np.ndarray:
    """Share of the sentences that are about each area."""
    about = model.about(grams)
    return np.bincount(about[about >= 0], minlength=len(model.subjects)) / max(len(grams.lengths), 1)


def _calibrate(model: Model, held: list[tuple[Grams, set[int]]], n: int) -> np.ndarray:
    """Per area the share with the best F1 on held-out documents, drawn to ``SHARE`` the more the fewer cases there are."""
    found = np.array([shares_of(model, g) for g, _ in held if len(g.lengths)]).reshape(-1, n)
    truth = np.array([[a in own for a in range(n)] for g, own in held if len(g.lengths)], dtype=bool).reshape(-1, n)
    grid = np.arange(0.15, 0.36, 0.01)
    out = np.empty(n)
    for a in range(n):
        f, t = found[:, a], truth[:, a]
        scores = np.array([2 * ((f >= x - 1e-9) & t).sum() / max((f >= x - 1e-9).sum() + t.sum(), 1) for x in grid])
        # Labels are partly wrong and documents short: shares within half a percent of the best F1 are equally good.
        best = min(grid[scores >= scores.max() - 0.005], key=lambda x: abs(x - SHARE))
        out[a] = (best * t.sum() + SHARE * PRIOR_CASES) / (t.sum() + PRIOR_CASES)
    return out


MAX_AREAS = 1_000


def area_key(c):
    """Letters of a subject in lower case, so that its spellings compare equal."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def train(docs: DataFrame, labels: DataFrame, areas: DataFrame, key: str = "doc_id", text: str = "text", max_docs: int = MAX_TRAIN_DOCS, max_sentences: int = MAX_TRAIN_SENTENCES) -> Model:
    """A model from weak labels (doc_id, subject as id or title in any spelling) and areas (subject, title, description).

    Of the labelled documents those with the least hashes of their id are
    taken: a part of the range of the hash that holds ``max_docs`` of them on
    average, and of these as many, in order of the hash, as have
    ``max_sentences`` sentences in all. Documents are taken whole. Labels that
    are no area, of documents that do not exist, or null say nothing.
    """
    listed = sorted((r["subject"], r["title"], r["description"]) for r in small_rows(areas.where("subject is not null").select("subject", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description")).distinct(), MAX_AREAS))
    spelled = {}
    for c in ("title", "subject"):
        for r in areas.where("subject is not null").select(area_key(F.col(c)).alias("k"), "subject").where("k <> ''").distinct().orderBy("k", F.desc("subject")).collect():
            spelled[r["k"]] = r["subject"]
    at = {s: i for i, (s, _, _) in enumerate(listed)}
    described = [(s, Grams.of([features(t), *[features(x) for x in sentences(d)]])) for s, t, d in listed]
    if not spelled:
        return fit([], described)
    names = docs.sparkSession.createDataFrame(sorted(spelled.items()), "_key string, _subject string")
    tagged = labels.select(F.col(key).alias("_id"), area_key(F.col("subject")).alias("_key")).where("_id is not null").join(F.broadcast(names), "_key")
    n = tagged.agg(F.approx_count_distinct("_id", 0.02)).first()[0]
    place = F.shiftrightunsigned(F.xxhash64("_id"), 11).cast("double") / F.lit(float(1 << 53))
    chosen = tagged.withColumn("_at", place).where(F.col("_at") < max_docs / max(n, 1)).groupBy("_at", "_id").agg(F.collect_set("_subject").alias("_own"))
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where("_text is not null")
    labelled = texts.join(F.broadcast(chosen), "_id").groupBy("_at", "_id", "_own").agg(F.max("_text").alias("_text"))

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            grams = [[features(s) for s in sentences(t)] for t in part["_text"]]
            yield pd.DataFrame({"_at": part["_at"], "_own": part["_own"], "_n": [len(g) for g in grams], "_grams": grams})

    read = cut(labelled.select("_at", "_own", "_text").mapInPandas(run, "_at double, _own array<string>, _n int, _grams array<array<int>>"))
    total, last = 0, 2.0
    for r in read.select("_at", "_n").orderBy("_at").collect():  # two numbers for each chosen document
        total += r["_n"]
        if total > max_sentences:
            last = r["_at"]
            break
    data = [(Grams.of(r["_grams"]), {at[s] for s in r["_own"]}) for r in read.where(F.col("_at") < last).orderBy("_at").toLocalIterator()]
    return fit(data, described)


def assign(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, subject, share) of every area of every document.

    Null, empty and blank texts, and texts without a sentence of letters, have
    no area. Long texts are read whole. Repeated rows give repeated rows, null
    keys null keys; other columns are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH x areas floats, whatever the corpus

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for part in parts:
            ids, subjects, shares = [], [], []
            for k, t in zip(part.iloc[:, 0], part.iloc[:, 1]):
                grams = Grams.of([features(s) for s in sentences(t)])
                if not len(grams.lengths):
                    continue
                found = shares_of(m, grams)
                for a in np.flatnonzero(found >= m.shares - 1e-9):
                    ids.append(k)
                    subjects.append(m.subjects[a])
                    shares.append(float(found[a]))
            yield pd.DataFrame({key: pd.Series(ids, dtype=part.iloc[:, 0].dtype), "subject": pd.Series(subjects, dtype=object), "share": pd.Series(shares, dtype=float)})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, subject string, share double")


def composition(docs: DataFrame, assigned: DataFrame, key: str = "doc_id", weight: str = "n_chars") -> DataFrame:
    """Documents and characters per area, and their shares of the whole corpus; ``none`` for documents of no area."""
    sized = docs.select(key, F.coalesce(weight, F.lit(0)).alias("_w"))
    labelled = sized.join(assigned.select(key, "subject"), key, "left").withColumn("subject", F.coalesce("subject", F.lit("none")))
    whole = sized.agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w")).first()
    out = labelled.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("_w").alias("chars"))
    return out.withColumn("share_of_documents", F.col("documents") / F.lit(float(max(whole["n"], 1)))).withColumn("share_of_chars", F.col("chars") / F.lit(float(max(whole["w"] or 1, 1))))
