"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

1. A lexicon is learned from labelled rows: whole words and word beginnings whose share of toxic rows
   is far above that of clean rows. It joins a short list of common insults. Counts are kept by fold,
   so that a training row is described with weights learned without its own fold.
2. Every text becomes one dense vector: lexicon densities, nearness of second-person words to lexicon
   hits, rates of capitals, punctuation and disguised words, length.
3. Spark ML fits boosted trees on three folds and an isotonic map from margin to probability on the
   fourth; both are applied to all rows.

Fitting takes at most `max_rows` labelled rows, chosen by a hash of their id; scoring reads whole texts
of all rows. A null or empty text has zero densities and gets the calibrated score of such a vector. A
null id is never a training row. With fewer than two labels of either kind, or one label only, every
row gets the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from yardframe.llm.tables import stored, text_of, trimmed

# Common English insults, and words that address the reader.
INSULTS = ("clown", "creep", "disgusting", "dumb", "filth", "fool", "garbage", "idiot", "imbecile", "jerk",
           "loser", "moron", "pathetic", "pig", "retard", "scum", "stupid", "trash", "ugly", "worthless")
YOU = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
       "tu", "te", "toi", "ton", "ta", "vous", "votre", "ti", "tus", "usted", "ustedes", "vosotros")
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")

FOLDS = 4
TERMS_AT_ONCE = 60_000  # distinct terms that a task counts before it hands the counts on
FEATURES = ("hits_per_100", "weight_per_100", "kinds", "strongest", "insults_per_100", "insults", "you_per_100", "you_near_hit",
            "capitals", "shouted", "exclaims", "punctuation", "disguised", "log_words", "hits")
_SPLIT = re.compile(r"[^\W_]+")
_MASKED = re.compile(r"[^\W\d_]+[0-9@$!|*][^\W\d_]+")


@dataclass
class Lexicon:
    """Terms with a weight from all rows (column 0) and from all rows but those of fold k (column k)."""

    terms: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, FOLDS + 1)))

    def tables(self, fold: int) -> dict[int, dict[str, float]]:
        """Weights by length of the beginning; 0 holds whole words."""
        out: dict[int, dict[str, float]] = {}
        for term, weight in zip(self.terms, self.weights[:, fold], strict=True):
            if weight > 0:
                whole = term.endswith(" ")
                out.setdefault(0 if whole else len(term), {})[term.rstrip(" ")] = float(weight)
        return out


BEGINNINGS = range(3, 8)


def terms_of(text: str) -> set[str]:
    """Lower-cased words (with a space behind) and their beginnings."""
    found: set[str] = set()
    for w in set(_SPLIT.findall(text.lower())):
        found.add(w + " ")
        found.update(w[:n] for n in BEGINNINGS if len(w) >= n)
    return found


def learn_lexicon(train: DataFrame, totals: dict[tuple[int, int], int], *, size: int, least: float = 2.0) -> Lexicon:
    """The `size` terms (most significant first) whose odds of a toxic row are e**least times a clean one's or more.

    train: text, label (0 or 1), fold (1..FOLDS). totals: its rows by label and fold.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            terms, folds, labels = zip(*held, strict=True) if held else ((), (), ())
            columns = [pa.array(terms, pa.string()), pa.array(folds, pa.int32()), pa.array(labels, pa.int32()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["term", "fold", "label", "n"])

        for batch in batches:
            for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
                held.update((t, fold, label) for t in terms_of(text))
                if len(held) > TERMS_AT_ONCE:
                    yield flush()
        yield flush()

    # Only toxic rows name terms; clean rows are counted for those.
    named = train.where("label = 1").select("text", "label", "fold").mapInArrow(trimmed(count), "term string, fold int, label int, n long")
    named = named.groupBy("term").agg(F.sum("n").alias("n")).where("n >= 2").select("term")
    counted = train.select("text", "label", "fold").mapInArrow(trimmed(count), "term string, fold int, label int, n long")
    by = [F.sum(F.when((F.col("fold") == f) & (F.col("label") == y), F.col("n")).otherwise(0)).alias(f"n{y}_{f}")
          for y in (0, 1) for f in range(1, FOLDS + 1)]
    counts = counted.join(named, "term", "left_semi").groupBy("term").agg(*by)

    def total(y: int, skip: int = 0) -> int:
        return sum(totals.get((y, f), 0) for f in range(1, FOLDS + 1) if f != skip)

    def odds(skip: int):
        hit, miss = (sum((F.col(f"n{y}_{f}") for f in range(1, FOLDS + 1) if f != skip), F.lit(0)) for y in (1, 0))
        return F.log((hit + 0.25) / (total(1, skip) + 0.5)) - F.log((miss + 0.25) / (total(0, skip) + 0.5))

    hits = sum((F.col(f"n1_{f}") for f in range(1, FOLDS + 1)), F.lit(0))
    ranked = counts.select("term", *[odds(k).alias(f"w{k}") for k in range(FOLDS + 1)], (hits * odds(0)).alias("gain"))
    top = ranked.where(F.col("w0") >= least).orderBy(F.desc("gain"), "term").limit(size).collect()
    weights = np.array([[max(0.0, r[f"w{k}"]) for k in range(FOLDS + 1)] for r in top]).reshape(-1, FOLDS + 1)
    weights[weights < least] = 0.0
    return Lexicon([r["term"] for r in top], weights)


def describe(text: str, tables: dict[int, dict[str, float]]) -> list[float]:
    """The features of one text. A word's weight is the largest of the terms that it matches."""
    n_chars = max(1, len(text))
    words = _SPLIT.findall(text)
    lowered = _SPLIT.findall(text.lower())
    n = max(1, len(lowered))
    weight_of: dict[str, float] = {}
    insults = 0
    for w in set(lowered):
        best = max((t.get(w[:k] if k else w, 0.0) for k, t in tables.items()), default=0.0)
        if w in INSULTS:
            best = max(best, 3.0)
        if best:
            weight_of[w] = best
    disguised = [m.translate(LOOKALIKE) for m in _MASKED.findall(text.lower())] if any(c in text for c in "@$!|*01345") else []
    masked_hits = [m for m in disguised if m in INSULTS or tables.get(0, {}).get(m)]
    hits = [i for i, w in enumerate(lowered) if w in weight_of] if weight_of else []
    insults = sum(lowered[i] in INSULTS for i in hits) + len(masked_hits)
    you = sum(lowered.count(y) for y in YOU)
    near = sum(any(w in YOU for w in lowered[max(0, i - 5) : i + 6]) for i in hits)
    total = sum(weight_of[lowered[i]] for i in hits) + 3.0 * len(masked_hits)
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    return [100.0 * (len(hits) + len(masked_hits)) / n, 100.0 * total / n, float(len(weight_of) + len(set(masked_hits))), max([*weight_of.values(), 3.0 * bool(masked_hits), 0.0]),
            100.0 * insults / n, float(insults), 100.0 * you / n, float(near),
            capitals / n_chars, sum(len(w) > 2 and w.isupper() for w in words) / n, text.count("!") / n_chars,
            sum(map(text.count, ".,;:?-\"'()")) / n_chars, 100.0 * len(disguised) / n, float(np.log1p(len(lowered))),
            float(len(hits) + len(masked_hits))]


def with_features(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """rows (key, text, fold, label) -> key, fold, label, features. Fold 0 takes the weights of all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [lexicon.tables(k) for k in range(FOLDS + 1)]
        for batch in batches:
            vectors = [describe(t.as_py(), tables[k]) for t, k in zip(batch.column("text"), batch.column("fold").to_pylist(), strict=True)]
            kept = [batch.column(c) for c in ("key", "fold", "label")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(vectors, pa.list_(pa.float64()))], ["key", "fold", "label", "features"])

    schema = rows.select("key", "fold", "label").schema.add("features", ArrayType(DoubleType()))
    return rows.select("key", "text", "fold", "label").mapInArrow(trimmed(run), schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
                   max_rows: int = 20_000, lexicon_size: int = 1_000, rounds: int = 20, row: str | None = None) -> DataFrame:
    """key, held_out, score, predicted for every row of docs. Repeated rows are each scored; `row` names a column that
    tells rows apart, which then comes first.

    labels may hold any further columns; rows whose label is null are not used, and an id with several labels
    counts as toxic if one of them is.
    """
    remainder = F.crc32(F.col("key").cast("string").cast("binary")) % 5
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label is not null")
    known = known.groupBy("key").agg(F.max("label").alias("label")).withColumn("fold", remainder.cast("int")).where("fold > 0")
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(max_rows)
    texts = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    # at most max_rows ids; of rows that repeat an id one text is learnt from
    train = stored(texts.join(F.broadcast(chosen), "key").groupBy("key", "label", "fold").agg(F.min("text").alias("text")))
    totals = {(r["label"], r["fold"]): r["count"] for r in train.groupBy("label", "fold").count().collect()}
    counts = Counter()
    for (y, _), n in totals.items():
        counts[y] += n
    held = F.coalesce(remainder, F.lit(0)) == 0
    named = [F.col("key").alias(key)] if row is None else [F.col("key.row").alias(row), F.col("key.key").alias(key)]
    if row is not None:
        texts = docs.select(F.struct(F.col(row).alias("row"), F.col(key).alias("key")).alias("key"), text_of(text).alias("text"))
        held = F.coalesce(F.crc32(F.col("key.key").cast("string").cast("binary")) % 5, F.lit(0)) == 0
    everything = texts.withColumn("fold", F.lit(0)).withColumn("label", F.lit(None).cast("int"))
    if min(counts.get(0, 0), counts.get(1, 0)) < 2:
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        return texts.select(*named, held.alias("held_out"), F.lit(share).alias("score"),
                            F.lit(int(share >= 0.5)).alias("predicted"))
    lexicon = learn_lexicon(train, totals, size=lexicon_size)
    vectors = stored(with_features(train, lexicon).withColumn("v", array_to_vector("features"))
                     .withColumn("y", F.col("label").cast("double")))
    fit_on, level_on = vectors.where("fold < 4"), vectors.where("fold = 4")
    if len({y for y, fold in totals if fold < 4}) < 2:
        fit_on = vectors
    if len({y for y, fold in totals if fold == 4}) < 2:
        level_on = vectors
    trees = GBTClassifier(featuresCol="v", labelCol="y", maxDepth=4, maxIter=rounds, stepSize=0.2, seed=7,
                          predictionCol="vote", maxMemoryInMB=64).fit(fit_on.coalesce(6))
    margin = vector_to_array("probability")[1].alias("margin")
    level = IsotonicRegression(featuresCol="margin", labelCol="y", predictionCol="level")
    level = level.fit(trees.transform(level_on).select("y", margin))
    scored = trees.transform(with_features(everything, lexicon).withColumn("v", array_to_vector("features"))).select("key", margin)
    # Isotonic levels are steps; a thousandth of the margin keeps the order inside a step.
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("level") + 0.001 * F.col("margin")))
    out = level.transform(scored).select(*named, held.alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
