"""Toxicity: boosted trees over dense text features, calibrated by isotonic regression.

The features of a text are rates: lexicon words (as written and with look-alike characters undone), the same
near a second-person pronoun, the heaviest stretch, capitals, punctuation, repeats and characters inside words
that hide letters. The lexicon is learned: words that are far more frequent in toxic texts than in others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, held_out, settled

#: Labelled rows that the lexicon, the trees and the calibration are fitted on, at most; drawn by a hash of the id.
SAMPLE = 20_000
#: Words and letter runs in the lexicon, at most; times as frequent in toxic texts, and in how many at least.
LEXICON, TIMES, LEAST = 2000, 8.0, 5
#: Share of the sample that calibrates.
CALIBRATE = 4
# fixed values: second-person words by language (English, German, French, Spanish)
SECOND = frozenset("you your yours yourself u du dich dir dein deine euch ihr tu te toi ton ta vous votre tú ti tus usted vosotros".split())
# fixed values: characters that stand for letters
LOOKALIKE = str.maketrans("013457@$!|", "oieastasii")
NEAR = 5
#: Characters of a text, rows of a table and words of a memory that are handled together.
CHUNK, BATCH, KNOWN = 1 << 18, 20_000, 300_000
_SPACE, _MARKS = re.compile(r"\s"), re.compile(r"[\W_]+")
_EDGE = re.compile(r"^[^\w@$!|*]+|[^\w@$|*]+$")
_INSIDE = re.compile(r"(?<=\w)[*.\-_@$!|#%&+](?=\w)|(?<=[^\W\d])\d(?=[^\W\d])")
_REPEAT = re.compile(r"(.)\1\1+")
#: Letters at the start of a word that may make it part of the lexicon by themselves.
STEMS = (5, 6)
NAMES = ["log_words", "lexicon", "lexicon_any", "lexicon_kinds", "plain_lexicon", "stem_lexicon", "near_second", "second", "densest", "capitals", "capital_words", "punctuation",
         "exclaims", "obfuscated", "repeats", "digits", "mean_length"]


def _plain(w: str) -> str:
    """A word without look-alikes, marks inside it and threefold letters."""
    return _REPEAT.sub(r"\1", _MARKS.sub("", w.translate(LOOKALIKE)))


def _parts(text: str) -> Iterator[str]:
    """The text in pieces that end at white space, about ``CHUNK`` characters each."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            m = _SPACE.search(text, end)
            end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def _terms(text: str) -> set[str]:
    """The terms that may enter the lexicon: words as written, plain words, and stems (marked)."""
    kinds = {w for part in _parts(text.lower()) for w in part.split()}
    out: set[str] = set()
    for w in kinds:
        w = w if w.isalpha() else _EDGE.sub("", w)
        p = _plain(w)
        out.update((w, "=" + p))
        out.update("^" + p[:n] for n in STEMS if len(p) > n)
    return out - {"", "="}


def _word(token: str, lexicon: dict[str, float]) -> tuple | None:
    """What one word adds to the features; None for the many that add nothing."""
    w, many = token.lower(), len(_REPEAT.findall(token))
    if not w.isalpha():
        w = _EDGE.sub("", w)
    p = w if w.isalpha() and not many else _plain(w)
    direct, undone = lexicon.get(w, 0.0) if w else 0.0, lexicon.get("=" + p, 0.0)
    stem = max([lexicon.get("^" + p[:n], 0.0) for n in STEMS if len(p) > n], default=0.0)
    shout = len(token) > 2 and token.isupper() and sum(map(str.isalpha, token)) > 2
    flags = (w in SECOND, shout, 0 if token.isalpha() else len(_INSIDE.findall(token)), many)
    weight = max(direct, undone, stem)
    return (weight, bool(direct), bool(undone), bool(stem), p, *flags) if weight or any(flags) else None


class Kinds:
    """Letters and capitals by code point, for those below 2^16."""

    table: np.ndarray | None = None

    @classmethod
    def count(cls, text: str) -> tuple[int, int]:
        if cls.table is None:
            cls.table = np.array([c.isalpha() + 2 * c.isupper() for c in map(chr, range(1 << 16))], np.uint8)
        letters = capitals = 0
        for part in _parts(text):
            code = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
            kind = cls.table[code[code < 1 << 16]]
            letters += int(np.count_nonzero(kind & 1))
            capitals += int(np.count_nonzero(kind & 2))
        return letters, capitals


def _features(text: str | None, lexicon: dict[str, float], seen: dict | None = None) -> list[float]:
    """``seen`` keeps what words add between texts; it never holds more than ``KNOWN`` words."""
    text, seen = text or "", {} if seen is None else seen
    words = hits = plain_hits = stem_hits = near = second = densest = shouts = inside = repeats = 0
    kinds: set[str] = set()
    last_you = last_hit = -10**9
    total = 0.0
    recent: list[int] = []
    for part in _parts(text):
        for token in part.split():
            words += 1
            try:
                found = seen[token]
            except KeyError:
                found = _word(token, lexicon)
                if len(seen) < KNOWN:
                    seen[token] = found
            if found is None:
                continue
            weight, direct, undone, stem, p, you, shout, marks, many = found
            shouts += shout
            inside += marks
            repeats += many
            if you:
                second += 1
                last_you = words
                near += words - last_hit <= NEAR
            if weight:
                hits += direct
                plain_hits += undone
                stem_hits += stem
                total += weight
                kinds.add(p)
                near += words - last_you <= NEAR
                last_hit = words
                recent = [x for x in recent if words - x < 50] + [words]
                densest = max(densest, len(recent))
    letters, caps = Kinds.count(text)
    n, chars = max(1, words), max(1, len(text))
    return [float(np.log1p(words)), hits / n, total, float(len(kinds)), plain_hits / n, stem_hits / n, near / n, second / n, float(densest), caps / max(1, letters),
            shouts / n, sum(map(text.count, ".,;:?'\"-")) / chars, text.count("!") / n, inside / n, repeats / n, sum(map(text.count, "0123456789")) / chars, letters / n]


@dataclass
class Model:
    """``trees`` and ``scale`` are null if no rows of both classes were there; then ``share`` is every score."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    scale: IsotonicRegressionModel | None
    share: float


def features(spark: SparkSession, text: Column, lexicon: dict[str, float]) -> Column:
    """Array of the numbers in ``NAMES`` for each whole text; a null text counts as empty."""
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict = {}
        for s in batches:
            yield pd.Series([_features(t, shared.value, seen) for t in s])

    return of(text)


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Log ratios of the terms that are at least ``TIMES`` as frequent in toxic texts, from rows (text, toxic)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bad, good = Counter(), Counter()
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"]):
                (bad if toxic else good).update(_terms(text or ""))
        terms = list(bad.keys() | good.keys())
        for at in range(0, len(terms), BATCH):
            some = terms[at:at + BATCH]
            yield pd.DataFrame({"term": pd.Series(some, dtype=object), "bad": [bad[t] for t in some], "good": [good[t] for t in some]})

    n = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    each = rows.mapInPandas(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = ((F.col("bad") + 0.5) / (n[0] + 1)) / ((F.col("good") + 0.5) / (n[1] + 1))
    kept = each.filter(F.col("bad") >= LEAST).withColumn("r", ratio).filter(F.col("r") >= TIMES).orderBy(F.col("bad").desc(), "term").limit(LEXICON)
    return {r["term"]: float(np.log(r["r"])) for r in kept.collect()}


def learn(spark: SparkSession, rows: DataFrame, seed: int = 7, rounds: int = 30, depth: int = 4) -> Model:
    """A model from rows (id, text, toxic), of which at most about ``SAMPLE`` are drawn by a hash of the id.

    Three quarters give lexicon and trees, the rest, unseen by both, the calibration.
    """
    rows = rows.filter("toxic is not null")
    total = rows.count()
    if total > SAMPLE:
        rows = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / total))
    rows = settled(rows.withColumn("toxic", (F.col("toxic") > 0).cast("int")).withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(CALIBRATE))))
    fit, rest = rows.filter("part > 0"), rows.filter("part = 0")
    classes = {(r["cal"], r["toxic"]) for r in rows.select((F.col("part") == 0).alias("cal"), "toxic").distinct().collect()}
    share = rows.agg(F.avg("toxic")).first()[0] or 0.0
    if not {(False, 0), (False, 1)} <= classes:
        return Model({}, None, None, float(share))
    lexicon = learn_lexicon(fit.select("text", "toxic"))
    data = settled(rows.select("part", F.col("toxic").cast("double").alias("label"), features(spark, F.col("text"), lexicon).alias("x")))
    data = data.withColumn("features", array_to_vector("x"))
    # few large partitions: a boosting round is a few short jobs
    train = data.filter("part > 0").repartition(max(1, min(8, total // 4000))).cache()
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, subsamplingRate=1.0, seed=seed, maxBins=64).fit(train)
    train.unpersist()
    scale = None
    if not rest.isEmpty():
        scored = trees.transform(data.filter("part = 0")).select("label", vector_to_array("probability")[1].alias("features"))
        scale = IsotonicRegression().fit(scored)
    return Model(lexicon, trees, scale, float(share))


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(id, score) of each row of (id, text)."""
    if model.trees is None:
        return docs.select("id", F.lit(model.share).alias("score"))
    data = docs.select("id", array_to_vector(features(spark, F.col("text"), model.lexicon)).alias("features"))
    raw = model.trees.transform(data).select("id", vector_to_array("probability")[1].alias("features"))
    if model.scale is None:
        return raw.select("id", F.col("features").alias("score"))
    # between equal calibrated values the trees' own order shows, by a hundredth of the way
    out = model.scale.transform(raw)
    return out.select("id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("prediction") + 0.01 * F.col("features"))).alias("score"))


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of each row of ``docs``; labels of held-out rows are never read.

    Null texts count as empty. An id with several labels is toxic if one of them is; null labels and ids teach
    nothing. Without labels of both classes every score is the share of toxic ones, or 0. Repeated rows are
    scored alike; other columns have no influence; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).filter("id is not null and toxic is not null")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    model = learn(spark, docs.join(broadcast_if_small(settled(known)), "id"))
    out = score(spark, docs, model)
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return predict(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
