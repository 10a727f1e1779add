"""Mixing sources to target shares by Poisson replication.

Each document gets, per mix, a uniform number from a hash of its id. Inverting
a Poisson distribution at that number gives its count of uses, cut at the cap.
The Poisson mean of a source starts from the one whose capped mean equals the
wanted repetition rate, and is then refined until the tokens drawn meet the
target: a few rounds sum, over all documents at once, what each mean on a
grid would draw. Sources are read to the driver (one number each); documents
never are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.tokenize import DEFAULT_FOLDER, DEFAULT_TOKENIZER, token_counts
from strandline.session import cut, small_rows

SEED = 20
GRID = 48
ROUNDS = 3
MAX_TARGETS = 10_000


def poisson_steps(mean: float, cap: int) -> list[float]:
    """P(X < j) for j = 1 .. cap: a document with uniform u is used as often as there are steps at or below u."""
    if mean == math.inf:
        return [0.0] * cap
    out, term, total = [], math.exp(-mean), 0.0
    for j in range(cap):
        total += term
        out.append(min(total, 1.0))
        term *= mean / (j + 1)
    return out


def capped_mean(mean: float, cap: int) -> float:
    """Mean of a Poisson count cut at ``cap``."""
    return sum(1 - s for s in poisson_steps(mean, cap))


def mean_for_rate(rate: float, cap: int) -> float:
    """The Poisson mean whose count, cut at ``cap``, has mean ``rate``; inf where even ``cap`` uses of all don't exceed it."""
    if rate <= 0 or cap <= 0:
        return 0.0
    if rate >= cap:
        return math.inf
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < rate:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < rate else (low, mid)
    return (low + high) / 2


def _uniform(mix: str, key: str, seed: int):
    """A number in [0, 1) from a hash of the key, the mix and the seed."""
    h = F.xxhash64(F.col(key), F.col(mix), F.lit(seed))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def _drawn(sized: DataFrame, grids: dict[tuple[str, str], tuple[list[float], int]], seed: int) -> dict[tuple[str, str], np.ndarray]:
    """Tokens each mean of a grid would draw, for every (mix, source): one pass over the documents, summed on the map side."""
    rows = [(m, s, i) for i, (m, s) in enumerate(grids)]
    plan = sized.sparkSession.createDataFrame(rows, "mix_name string, source string, _slot int")
    steps = [np.array([poisson_steps(x, cap) for x in means]).reshape(len(means), cap) for means, cap in grids.values()]
    placed = sized.join(F.broadcast(plan), "source").select("_slot", _uniform("mix_name", "_key", seed).alias("u"), "n_tokens")

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for part in parts:
            for slot, rows in part.groupby("_slot"):
                u, n = rows["u"].to_numpy(), rows["n_tokens"].to_numpy()
                order = np.argsort(u)
                u, summed = u[order], np.concatenate(([0], np.cumsum(n[order])))
                drawn = (summed[-1] - summed[np.searchsorted(u, steps[slot], side="left")]).sum(axis=1)
                total[slot] = total.get(slot, 0) + drawn
        for slot, drawn in total.items():
            yield pd.DataFrame({"_slot": slot, "g": np.arange(len(drawn)), "drawn": drawn})

    out = placed.mapInPandas(run, "_slot int, g int, drawn long").groupBy("_slot", "g").agg(F.sum("drawn").alias("drawn")).collect()
    found = {k: np.zeros(len(means), dtype=np.int64) for k, (means, _) in grids.items()}
    names = list(grids)
    for r in out:
        found[names[r["_slot"]]][r["g"]] = r["drawn"]
    return found


def sized_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", name: str = DEFAULT_TOKENIZER, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """_key, source and n_tokens of every document, written once to the shared checkpoint folder."""
    packed = docs.select(F.struct(F.col(key).alias("k"), F.col(source).alias("s")).alias("_ks"), F.col(text).alias("_text"))
    counts = token_counts(packed, "_ks", "_text", name, folder)
    return cut(counts.select(F.col("_ks.k").alias("_key"), F.col("_ks.s").alias("source"), "n_tokens"))


def fit_means(sized: DataFrame, targets: list[tuple[str, str, float, int]], seed: int = SEED) -> dict[tuple[str, str], tuple[float, int, float]]:
    """(mix, source) -> Poisson mean, cap, target tokens. ``targets``: mix, source, share, cap."""
    per_source = {r["source"]: (r["t"] or 0, r["n"]) for r in sized.where("source is not null").join(F.broadcast(sized.sparkSession.createDataFrame([(s,) for s in sorted({t[1] for t in targets})], "source string")), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    everything = sized.agg(F.sum("n_tokens")).first()[0] or 0
    fitted: dict[tuple[str, str], tuple[float, int, float]] = {}
    open_: dict[tuple[str, str], tuple[float, float]] = {}
    for mix, source, share, cap in targets:
        want, have = share * everything, per_source.get(source, (0, 0))[0]
        mean = mean_for_rate(want / have, cap) if have else 0.0
        fitted[mix, source] = (mean, cap, want)
        if 0 < mean < math.inf:
            open_[mix, source] = (mean / 4, mean * 4 + 1)
    for _ in range(ROUNDS if open_ else 0):
        grids = {k: (list(np.linspace(low, high, GRID)), fitted[k][1]) for k, (low, high) in open_.items()}
        for k, drawn in _drawn(sized, grids, seed).items():
            means, (_, cap, want) = grids[k][0], fitted[k]
            i = int(np.searchsorted(drawn, want))
            near = min((x for x in (i - 1, i) if 0 <= x < GRID), key=lambda x: abs(drawn[x] - want))
            fitted[k] = (float(means[near]), cap, want)
            open_[k] = (means[max(i - 1, 0)], means[min(i, GRID - 1)])
    return fitted


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = SEED, name: str = DEFAULT_TOKENIZER, folder: str = DEFAULT_FOLDER) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (mix_name, doc_id, source, n_tokens, uses) and the shares reached.

    Each source of a mix is to have ``target_share`` of all tokens of the
    corpus, no document being used more than ``max_repeats`` times; a source
    too small for its share is used as often as allowed and falls short, one
    without documents reaches 0. Shares are reported against all tokens of the
    corpus (``share``) and within the mix (``share_of_mix``).

    Documents without a source belong to no mix but count in the corpus.
    Documents of no tokens may be chosen and add nothing. Repeated ids draw
    the same count each. A target of null or negative share or cap counts as
    0; of a (mix, source) given twice, shares add and the greater cap counts.
    ``targets`` is a short list, read to the driver and refused beyond ``MAX_TARGETS``. The same seed gives
    the same choice, whatever the partitioning.
    """
    spark = docs.sparkSession
    summed = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.sum(F.greatest("target_share", F.lit(0.0))).alias("target_share"), F.max(F.greatest("max_repeats", F.lit(0))).alias("max_repeats"))
    rows = small_rows(summed, MAX_TARGETS)
    wanted = sorted((r["mix_name"], r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in rows)
    sized = sized_documents(docs, key, name=name, folder=folder)
    fitted = fit_means(sized, wanted, seed)
    share = {(m, s): x for m, s, x, _ in wanted}
    plan = spark.createDataFrame(
        [(m, s, share[m, s], cap, want, poisson_steps(mean, cap) if mean > 0 else []) for (m, s), (mean, cap, want) in fitted.items()],
        "mix_name string, source string, target_share double, max_repeats int, target_tokens double, _steps array<double>",
    )
    drawn = sized.join(F.broadcast(plan), "source").withColumn("_u", _uniform("mix_name", "_key", seed))
    drawn = drawn.withColumn("uses", F.size(F.filter("_steps", lambda s: s <= F.col("_u"))).cast("bigint")).where("uses > 0")
    chosen = drawn.select("mix_name", F.col("_key").alias(key), "source", "n_tokens", "uses")
    sums = chosen.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("documents"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"))
    everything = sized.agg(F.sum("n_tokens")).first()[0] or 0
    reached = plan.drop("_steps").join(sums, ["mix_name", "source"], "left").fillna(0, ["documents", "uses", "tokens"])
    whole = sums.groupBy("mix_name").agg(F.sum("tokens").alias("_mix"))
    reached = reached.join(whole, "mix_name", "left").select(
        "mix_name", "source", "target_share", "max_repeats", "documents", "uses", "tokens",
        (F.col("tokens") / F.lit(float(max(everything, 1)))).alias("share"),
        F.coalesce(F.try_divide("tokens", "_mix"), F.lit(0.0)).alias("share_of_mix"),
    )
    return chosen, reached


def replicate(chosen: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """One row per use of a chosen document, all mixes shuffled globally by a hash.

    A range partitioning on a hash of (mix, id, copy) spreads sources, mixes
    and copies evenly, and sorting by it within partitions makes the order of
    the whole output a random one that is the same on every run.
    """
    copies = chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
    keyed = copies.withColumn("shuffle_key", F.xxhash64("mix_name", key, "copy", F.lit(seed)))
    return keyed.select("mix_name", key, "source", "n_tokens", F.col("copy").cast("bigint").alias("copy"), "shuffle_key").orderBy("shuffle_key")
