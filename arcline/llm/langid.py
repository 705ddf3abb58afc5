"""Language of each text as a mixture of languages (Lui, Lau and Baldwin, 2014).

Every language has a distribution of character n-grams, learned from all labelled rows. A text is a mixture:
expectation-maximisation estimates the share of each language from the n-gram likelihoods, and languages join
the set one at a time as long as the likelihood rises by more than a penalty. The largest share is the
prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out

UNKNOWN = "und"
#: Length of an n-gram in characters.
GRAM = 3
#: Cells of a model over all its languages: the size that is broadcast is bounded whatever the data.
CELLS = 1 << 22
MOST_BITS, LEAST_BITS = 16, 8
#: Share of the pooled distribution in each language's, and of a uniform one in the pooled.
POOLED, UNIFORM = 0.02, 0.01
STEPS = 12
#: Log likelihood that one more language must bring, for each unit of log(n-grams).
PENALTY = 3.0
#: Characters of a text that are turned into n-grams at a time.
CHUNK = 1 << 18
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _grams(text: str, bits: int) -> Iterator[np.ndarray]:
    """Cells of the n-grams of a text: lower case, one blank for whatever is no letter, also at both ends."""
    line = f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "
    for at in range(0, len(line) - GRAM + 1, CHUNK):
        c = np.frombuffer(line[at:at + CHUNK + GRAM - 1].encode("utf-32-le", "replace"), np.uint32)
        n = len(c) - GRAM + 1
        h = np.zeros(n, np.uint32)
        for k in range(GRAM):
            h = (h ^ c[k:k + n]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        yield h >> np.uint32(32 - bits)


class Model:
    """Log probabilities by cell and language; ``langs`` in code point order."""

    def __init__(self, langs: list[str], bits: int, counts: np.ndarray):
        self.langs, self.bits = langs, bits
        size = 1 << bits
        pooled = (1 - UNIFORM) * counts.sum(axis=1) / max(1, counts.sum()) + UNIFORM / size
        own = counts / np.maximum(1, counts.sum(axis=0))
        self.prob = ((1 - POOLED) * own + POOLED * pooled[:, None]).astype(np.float32)

    def shares(self, text: str) -> tuple[str, float]:
        """(language, score) of a text that holds a letter."""
        cells = np.concatenate(list(_grams(text, self.bits)))
        if len(cells) > CHUNK:
            each = np.bincount(cells, minlength=1 << self.bits)
            cells = np.flatnonzero(each)
            n = each[cells].astype(float)
        else:
            cells, each = np.unique(cells.astype(np.uint16) if self.bits <= 16 else cells, return_counts=True)
            n = each.astype(float)
        p = self.prob[cells].astype(float)
        single = n @ np.log(p)
        chosen, best = [int(np.argmax(single))], single.max()
        share = np.ones(1)
        if len(self.langs) > 1:
            mixed, _ = _mixture(p, n)
            penalty = PENALTY * np.log(n.sum() + 1)
            for k in np.argsort(-mixed, kind="stable"):
                if k == chosen[0]:
                    continue
                if mixed[k] * n.sum() < 1:
                    break
                more, likelihood = _mixture(p[:, [*chosen, k]], n)
                if likelihood - best <= penalty:
                    break
                chosen, best, share = [*chosen, int(k)], likelihood, more
        top = int(np.argmax(share))
        # how surely the text is this language rather than another, were it in one: n-grams overlap, so each counts in part
        alone = np.exp((single - single.max()) / GRAM)
        sure = alone[chosen[top]] / alone.sum() if len(chosen) == 1 else 1.0
        return self.langs[chosen[top]], float(min(1.0, share[top] * sure))


def _mixture(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the columns of ``p`` that explain ``n`` best, and the log likelihood."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(STEPS):
        share = share * (p.T @ (n / (p @ share))) / total
    return share, float(n @ np.log(p @ share))


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the n-grams of all rows whose text and language are not null.

    N-grams fall into cells by hash. Each task sums what it reads, cells are summed by language, and the
    driver gets at most ``CELLS`` sums; with more languages each has fewer cells.
    """
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit((CELLS >> LEAST_BITS) + 1).collect())
    if len(langs) > CELLS >> LEAST_BITS:
        raise ValueError(f"more than {CELLS >> LEAST_BITS} languages")
    bits = MOST_BITS
    while len(langs) << bits > CELLS:
        bits -= 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"]):
                sums = total.setdefault(lang, np.zeros(1 << bits, np.int64))
                for cells in _grams(text, bits):
                    sums += np.bincount(cells, minlength=1 << bits)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": lang, "cell": at, "n": sums[at]})

    sums = rows.mapInPandas(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 << bits, len(langs)))
    place = {x: k for k, x in enumerate(langs)}
    counts[sums["cell"].to_numpy(), sums["lang"].map(place).to_numpy(dtype=int)] = sums["n"].to_numpy()
    return Model(langs, bits, counts)


def identify(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct(lang, score) of each whole text; ``und`` and 0 if it is null, has no letter, or nothing was learned."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in batches:
            yield pd.DataFrame([(UNKNOWN, 0.0) if t is None or not m.langs else m.shares(t) for t in s], columns=["lang", "score"])

    return of(F.when(has_letter(text), text))


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): learned from the rows that are not held out, given for every row.

    Null and letterless texts are ``und`` with score 0, and so is everything if no row can be learned from. A
    null id is not held out; repeated rows count as often as they occur; other columns have no influence.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = learn(docs.filter(~held_out(F.col("id"))))
    out = docs.select("id", identify(docs.sparkSession, model, F.col("text")).alias("p"))
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    return predict(spark.read.parquet(f"{sf_dir}/documents.parquet"))
