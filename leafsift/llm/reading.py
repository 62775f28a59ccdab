"""Reading level of texts: boosted regression trees over how a text is made, calibrated to grades.

Features are distributions, not words: lengths of sentences and words, their spread within and
between sentences, vocabulary (share of long words, of distinct and of single words), syntax (commas,
joining words, marks in each sentence) and cohesion (words shared by neighbouring sentences).

A sentence ends with its line, or with a mark that white space follows, so numbers such as 2.5 end none.

Training rows are a bounded sample of the labelled texts (``TRAIN_ROWS``, in the order of a hash),
whose features alone go to the driver. Folds are made of whole drugs, so copies of a leaflet never
stand on both sides. The cuts between grades come from out-of-fold predictions. In the report nothing
is fitted on what it is measured on: trees and cuts of each fold come from its training part alone,
and so does each source's row, from the texts of all other sources.

Defined results: null, blank, empty and ``NA`` texts have no level. Without labelled rows every
level is null. Repeated rows get equal levels. Very long texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.llm.boosting import Boosted, fit, thresholds
from leafsift.session import ship

TRAIN_ROWS, FOLDS, LEVELS = 6000, 5, range(1, 5)
_STOPS, _MARKS = ".!?;:", ",()+-–—•*#/|\"“”"
_VOWELS = [ord(c) for c in "aeiouáàâãéèêíìîóòôõúùûüAEIOUÁÀÂÃÉÈÊÍÌÎÓÒÔÕÚÙÛÜ"]
# Words that join clauses, in the languages of the corpus.
_JOINING = frozenset(
    "e ou mas porque por isso então enquanto quando se que embora contudo não obstante caso contrário modo ao passo medida "
    "tendo vista vez bem como razão qual sobretudo só pois portanto entretanto conforme segundo mediante and or but because "
    "so while when although if pero porque así mientras cuando aunque".split()
)
NAMES = (
    "words", "sentences", "sent_mean", "sent_sd", "sent_p10", "sent_p50", "sent_p90", "sent_max", "word_mean", "word_sd", "word_p90",
    "long7", "long10", "long13", "distinct", "once", "within_mean_sd", "within_p10", "within_p50", "within_p90", "long_sent_share", "plain_sent_share",
    "commas", "joining", "marks", "cohesion", "digits", "capitals", "vowels",
)


def _spread(x: np.ndarray, n: int) -> tuple[float, float]:
    mean = float(x.sum()) / n
    return mean, max(float(x @ x) / n - mean * mean, 0.0) ** 0.5


def features(text: str) -> list[float]:
    low = text.lower()
    marked = low.replace("\r", "\n").replace("\t", " ").replace("\xa0", " ")
    for c in _STOPS:
        marked = marked.replace(c + " ", "\n").replace(c + "\n", "\n")
    marked = marked.strip(_STOPS)
    for c in _MARKS:
        marked = marked.replace(c, " ")
    sents = [w for w in map(str.split, marked.split("\n")) if w]
    chars = np.bincount(np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 383), minlength=384)
    if not sents:
        sents = [marked.split() or ["x"]]
    k = len(sents)
    every = list(chain.from_iterable(sents))
    n = len(every)
    sizes = np.fromiter(map(len, sents), float, k)
    lens = np.fromiter(map(len, every), float, n)
    starts = np.zeros(k, dtype=np.int64)
    starts[1:] = np.cumsum(sizes[:-1])
    means = np.add.reduceat(lens, starts) / sizes
    longs = np.add.reduceat((lens >= 10).astype(float), starts) / sizes
    counts = Counter(every)
    shared, before = 0.0, None
    for s in sents:
        now = {w for w in s if len(w) > 3}
        if before is not None:
            shared += len(now & before) / (min(len(now), len(before)) or 1)
        before = now
    sent_mean, sent_sd = _spread(sizes, k)
    word_mean, word_sd = _spread(lens, n)
    _, mean_sd = _spread(means, k)
    q, m, ws = np.sort(sizes), np.sort(means), np.sort(lens)
    at = [int(f * (k - 1)) for f in (0.1, 0.5, 0.9)]
    long = [n - int(ws.searchsorted(c)) for c in (7, 10, 13)]
    return [
        log1p(n), log1p(k), sent_mean, sent_sd, q[at[0]], q[at[1]], q[at[2]], q[-1], word_mean, word_sd, ws[int(0.9 * (n - 1))],
        long[0] / n, long[1] / n, long[2] / n, len(counts) / n**0.5, list(counts.values()).count(1) / n,
        mean_sd, m[at[0]], m[at[1]], m[at[2]], np.count_nonzero(longs > 0.2) / k, np.count_nonzero(longs == 0) / k,
        low.count(",") / k, sum(counts[w] for w in _JOINING & counts.keys()) / n, (low.count("(") + low.count(":")) / k,
        shared / max(k - 1, 1), chars[48:58].sum() / len(text), (chars[65:91].sum() + chars[192:223].sum()) / len(text), chars[_VOWELS].sum() / len(text),
    ]


def _features_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [float(v) for v in features(t)] for t in texts.to_pylist()], pa.list_(pa.float64()))

    return made(text)


def training_sample(
    texts: DataFrame, labels: DataFrame, keys: list[str], level: str, group: str, rows: int = TRAIN_ROWS, sources: tuple[str, ...] = ()
) -> DataFrame:
    """(keys, sources, group, level, x) of at most ``rows`` labelled texts; the sample is broadcast, never the labels."""
    sample = labels.select(*keys, F.col(level).alias("nivel")).where("nivel is not null").dropDuplicates(keys)
    sample = sample.orderBy(F.xxhash64(*keys), *keys).limit(rows)
    d = texts.join(F.broadcast(sample), keys).dropDuplicates(keys)
    return d.select(*dict.fromkeys([*keys, *sources]), F.col(group).alias("grupo"), "nivel", _features_column(F.col("texto")).alias("x")).where("x is not null")


class Levels:
    """Fitted trees and the cuts between grades, from predictions of texts of drugs that the trees predicting them never saw."""

    def __init__(self, x: np.ndarray, y: np.ndarray, groups: np.ndarray, folds: int = FOLDS, tried: int | None = None):
        """``tried``: how many of the folds the cuts come from, all by default."""
        out, seen, fold = np.full(len(y), y.mean()), np.zeros(len(y), bool), groups % folds
        for k in range(folds if tried is None else tried):
            test = fold == k
            if test.any() and not test.all():
                out[test] = fit(x[~test], y[~test]).predict(x[test])
                seen |= test
        self.model: Boosted = fit(x, y)
        self.cuts = thresholds(out[seen], y[seen], LEVELS) if seen.any() else np.array([k + 0.5 for k in LEVELS][:-1])

    def level(self, raw: np.ndarray) -> np.ndarray:
        return 1 + np.searchsorted(self.cuts, raw, "right").astype(np.int32)


def collected(sample: DataFrame, keys: list[str]) -> list:
    """The bounded sample, in an order that doesn't depend on partitions."""
    rows = sample.withColumn("g", F.pmod(F.xxhash64("grupo"), F.lit(1009)).cast("int")).collect()
    rows.sort(key=lambda r: [str(r[k]) for k in keys])
    return rows


def _arrays(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([r["x"] for r in rows]), np.array([float(r["nivel"]) for r in rows]), np.array([r["g"] for r in rows])


def train(rows: list) -> Levels | None:
    return Levels(*_arrays(rows)) if rows else None


def predicted(texts: DataFrame, model: Levels | None, most_stretch: int | None = None) -> DataFrame:
    """``texts`` without texto, with nivel; ``most_stretch`` leaves out texts with a longer unbroken stretch."""
    ship(texts.sparkSession)
    from leafsift.llm.splitting import unbroken

    keep = [c for c in texts.columns if c not in ("texto", "nivel")]
    if model is None:
        return texts.select(*keep, F.lit(None).cast("int").alias("nivel"))

    @F.arrow_udf("int")
    def level(ts: pa.Array) -> pa.Array:
        out: list[int | None] = []
        for at in range(0, len(ts), 1000):
            part = ts.slice(at, 1000).to_pylist()
            ok = [t is not None and not (most_stretch and unbroken(t, most_stretch)) for t in part]
            x = [features(t) for t, k in zip(part, ok) if k]
            got = iter(model.level(model.model.predict(np.array(x, dtype=float))).tolist() if x else [])
            out += [next(got) if k else None for k in ok]
        return pa.array(out, pa.int32())

    return texts.select(*keep, level("texto").alias("nivel")).where("nivel is not null")


def report(rows: list, spark, sources: tuple[str, ...], folds: int = FOLDS) -> DataFrame:
    """(prova, fonte, textos, exatos, vizinhos, vies): agreement on texts that took no part in the fit.

    ``prova`` is ``dobra`` for folds of whole drugs, by the first of ``sources``, or ``fonte`` for a value of
    a source whose texts were all held out. Shares of exact grades and of those within one, mean error.
    """
    schema = "prova string, fonte string, textos int, exatos double, vizinhos double, vies double"
    if not rows:
        return spark.createDataFrame([], schema)
    x, y, g = _arrays(rows)
    out = []

    def measured(held: np.ndarray) -> np.ndarray:
        model = Levels(x[~held], y[~held], g[~held] // folds, 4, 1)
        return model.level(model.model.predict(x[held]))

    def add(kind: str, name: str, want: np.ndarray, got: np.ndarray) -> None:
        out.append((kind, name, len(want), float(np.mean(got == want)), float(np.mean(abs(got - want) <= 1)), float(np.mean(got - want))))

    got = np.zeros(len(y))
    folded = np.zeros(len(y), bool)
    for k in range(folds):
        held = g % folds == k
        if held.any() and not held.all():
            got[held], folded = measured(held), folded | held
    for value in sorted({str(r[sources[0]]) for r in rows}):
        mine = np.array([str(r[sources[0]]) == value for r in rows]) & folded
        if mine.any():
            add("dobra", f"{sources[0]}={value}", y[mine], got[mine])
    for source in sources:
        for value in sorted({str(r[source]) for r in rows}):
            held = np.array([str(r[source]) == value for r in rows])
            if not held.all():
                add("fonte", f"{source}={value}", y[held], measured(held))
    return spark.createDataFrame(out, schema)
