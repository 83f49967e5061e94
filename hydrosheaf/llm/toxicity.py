"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Labelled rows are dealt by crc32(doc_id) mod 5: 0 is held out and never read; 1 and 2 give the
lexicon, 3 the trees, 4 the calibration, so no part learns from counts made on its own rows.  The
fit uses at most ``SAMPLE`` labelled rows, chosen by a hash; scoring reads every whole text.

The lexicon holds words and word beginnings that toxic texts use far more often than others.
Features per text: lexicon hits, distinct hits, densities and weights, hits near a second-person
word, shares of capitals, of punctuation and of exclamation marks, share of words that hide letters
behind digits or symbols, and length.  Labels, language, source and id are no features.

Null and empty texts score like a text without words.  Repeated rows score alike.  Without labels of
both kinds every text scores the share of toxic labels (0 with none).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrosheaf.llm import textbytes as tb
from hydrosheaf.llm.tables import staged

SAMPLE = 40_000          # most labelled rows that the fit reads
LEXICON = 3_000          # most entries of the lexicon
LEAST_TOXIC = 5          # toxic texts of the lexicon's fold that hold an entry
LEAST_ODDS = 2.0         # log of the ratio of document frequencies
STEMS = (4, 5, 6)        # lengths of word beginnings
NEAR = 3                 # words between a hit and a second-person word
FEATURES = (
    "hits", "distinct", "density", "weight", "heaviest", "near_you", "capitals", "punctuation", "exclaims", "hidden", "log_words",
)
# fixed values: second-person words of English, German, French and Spanish
YOU = frozenset(
    "you your yours yourself du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
# fixed values: digits and signs that stand for letters
DISGUISE = str.maketrans("0134578@$!", "oleastbasi")
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’¡¿…–—·"
_INNER = re.compile(r"[^\W\d_][^\w\s'’\-./]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def plain(token: str) -> str:
    """The word inside a token: edges stripped, letters behind digits and signs restored."""
    w = token.strip(EDGE)
    if not w.isalpha() and _INNER.search(w):
        w = re.sub(r"[*_.\-]", "", w.translate(DISGUISE))
    return w


def entries(token: str) -> list[str]:
    """What the lexicon may hold of a token: the word and its beginnings, marked with a dash."""
    w = plain(token)
    return [w, *[w[:n] + "-" for n in STEMS if len(w) >= n]] if w else []


def count_entries(batches):
    """Document frequencies of entries in toxic and other texts, summed per slice."""
    for batch in batches:
        for part, _, _ in tb.slices(batch):
            toxic, other = Counter(), Counter()
            for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                seen = {e for t in set((text or "").lower().split()) for e in entries(t)}
                (toxic if label else other).update(seen)
            both = list(toxic.keys() | other.keys())
            yield pa.RecordBatch.from_pydict({
                "entry": pa.array(both, pa.string()), "toxic": pa.array([toxic[e] for e in both], pa.int64()), "other": pa.array([other[e] for e in both], pa.int64()),
            })


def learn_lexicon(labelled: DataFrame, limit: int = LEXICON) -> dict[str, float]:
    """Entries with their log odds; ``labelled(text, toxic)``.  At most ``limit`` come to the driver."""
    size = labelled.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("t"), F.count(F.when(F.col("toxic") == 0, 1)).alias("o")).first()
    odds = F.log((F.col("toxic") + 0.5) / (size["t"] + 1.0)) - F.log((F.col("other") + 0.5) / (size["o"] + 1.0))
    found = (
        labelled.select("text", "toxic").mapInArrow(count_entries, "entry string, toxic bigint, other bigint")
        .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .filter(F.col("toxic") >= LEAST_TOXIC).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc("toxic"), "entry").limit(limit).select("entry", "odds").collect()
    )
    return {r["entry"]: float(r["odds"]) for r in found}


_UPPER, _LETTER, _MARK, _LOUD = (np.zeros(256, np.int64) for _ in range(4))
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:0xF5] = 1
for _b in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)):
    _MARK[_b] = 1
_LOUD[33] = 1


def features(lexicon: dict[str, float], inside: str | None = None):
    """Function for ``mapInArrow``: the text column, or that of the struct ``inside``, to its features."""

    def run(batches):
        known: dict[str, float] = {}

        def weight(token: str) -> float:
            got = known.get(token)
            if got is None:
                if len(known) > 100_000:
                    known.clear()
                got = known[token] = max((lexicon.get(e, 0.0) for e in entries(token)), default=0.0)
            return got

        for batch in batches:
            if inside:                            # shares the struct's memory
                batch = batch.append_column("text", pc.struct_field(batch.column(inside), "text"))
            for part, data, offsets in tb.slices(batch):
                total = [np.concatenate(([0], np.cumsum(t[data]))) for t in (_UPPER, _LETTER, _MARK, _LOUD)]
                upper, letter, mark, loud = ((c[offsets[1:]] - c[offsets[:-1]]).astype(float) for c in total)
                rows = []
                for text in part.column("text").to_pylist():
                    tokens = (text or "").lower().split()
                    counts = Counter(tokens)
                    bad = {t: (w, n) for t, n in counts.items() if (w := weight(t))}
                    hidden = sum(n for t, n in counts.items() if not t.isalpha() and _INNER.search(t))
                    n = max(len(tokens), 1)
                    hits = sum(k for _, k in bad.values())
                    near = 0
                    if bad and not YOU.isdisjoint(counts):
                        you = np.array([i for i, t in enumerate(tokens) if t in YOU])
                        at = np.array([i for i, t in enumerate(tokens) if t in bad])
                        j = np.searchsorted(you, at)
                        gap = np.minimum(np.abs(you[np.minimum(j, len(you) - 1)] - at), np.abs(you[np.maximum(j - 1, 0)] - at))
                        near = int((gap <= NEAR).sum())
                    rows.append((
                        hits, len(bad), hits / n, sum(w * k for w, k in bad.values()) / n, max((w for w, _ in bad.values()), default=0.0),
                        near / n, hidden / n, np.log1p(len(tokens)),
                    ))
                got = np.array(rows, float)
                size = np.maximum(offsets[1:] - offsets[:-1], 1)
                columns = dict(zip(("hits", "distinct", "density", "weight", "heaviest", "near_you", "hidden", "log_words"), got.T))
                columns |= {"capitals": upper / np.maximum(letter, 1), "punctuation": mark / size, "exclaims": loud / size}
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in part.schema.names if c != "text"], *[pa.array(columns[f], pa.float64()) for f in FEATURES]],
                    names=[*[c for c in part.schema.names if c != "text"], *FEATURES],
                )

    return run


def with_features(docs: DataFrame, lexicon: dict[str, float], inside: str | None = None) -> DataFrame:
    """``docs`` with its text column replaced by the features, or with those of a struct's text added."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(features(lexicon, inside), f"{kept}, " + ", ".join(f"{f} double" for f in FEATURES))


class Model:
    """Lexicon, trees and calibration; ``score`` adds ``score`` to (doc_id, ...)."""

    def __init__(self, lexicon, trees=None, calibration=None, share: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, docs: DataFrame, inside: str | None = None) -> DataFrame:
        if self.trees is None:
            return docs.drop("text").withColumn("score", F.lit(self.share))
        names = [c for c in docs.columns if c != "text"]
        raw = _raw(self.trees, with_features(docs, self.lexicon, inside))
        return self.calibration.transform(raw).select(*names, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def _raw(trees, rows: DataFrame) -> DataFrame:
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="_x")
    return trees.transform(vector.transform(rows)).withColumn("_raw", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction", *FEATURES)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows of ``labels``, which bounds the broadcast and all that follows."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold(F.col("doc_id")) != 0).select(
        "doc_id", "toxic", fold(F.col("doc_id")).alias("fold"))
    n = usable.count()
    share = min(1.0, 0.98 * sample / max(n, 1)) if n > sample else 1.0
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = usable.filter(draw < share).dropDuplicates(["doc_id"]).limit(sample)
    rows = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "fold"))
    kinds = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, every = sum(v for (_, t), v in kinds.items() if t == 1), sum(kinds.values())
    if not all(kinds.get((f, t)) for f in (3, 4) for t in (0, 1)):
        return Model({}, share=toxic / every if every else 0.0)
    lexicon = learn_lexicon(rows.filter("fold IN (1, 2)"))
    dense = staged(with_features(rows.filter("fold IN (3, 4)").coalesce(4), lexicon))
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="_x")
    trees = GBTClassifier(
        featuresCol="_x", labelCol="_y",
        maxIter=20, maxDepth=3, stepSize=0.2, minInstancesPerNode=10, seed=17,
    ).fit(vector.transform(dense.filter("fold = 3").withColumn("_y", F.col("toxic").cast("double"))))
    raw = _raw(trees, dense.filter("fold = 4")).select("_raw", F.col("toxic").cast("double").alias("_y"))
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="_y", predictionCol="score").fit(raw)
    return Model(lexicon, trees, calibration)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    got = fit(docs, labels, sample).score(docs.select("doc_id", "text"))
    return got.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: float = 0.5) -> DataFrame:
    """The documents that score below ``limit``; columns of ``docs``."""
    names = docs.columns
    model = fit(docs, labels, sample)
    if model.trees is None:
        return docs if model.share < limit else docs.limit(0)
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_whole"))
    kept = model.score(carried, "_whole").filter(F.col("score") < limit)
    return kept.select(*[F.col("_whole")[c].alias(c) for c in names])
