"""Cross-entropy difference of each document between a target and a background model (Moore and Lewis, 2010).

Both are bigram models over one vocabulary, from the exact counts of all words and pairs of neighbouring words
(64-bit hashes name them). Counts come from all documents (background) and from those marked as target. They are
matched: background counts are scaled to the target's number of words, so that smoothing weighs the same in both. A
document is left out of the counts that score it, so being part of the target is no advantage by itself.

No table of counts is ever whole anywhere. Documents are dealt into chunks of bounded length; a chunk tallies its own
words and pairs, and gets back the totals of those that other chunks hold as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arcline.session import Kept

from .common import broadcast_if_small, settled

#: Single words are smoothed over 2 ** LEAST_BITS kinds at least, in a large corpus one for so many words.
LEAST_BITS = 16
WORDS_PER_KIND = 16
#: Words that single-word estimates weigh as beside the pairs of a first word; words added to all kinds, as a share.
BACKOFF, SMOOTH = 20.0, 0.05
#: Words of a text that are hashed at a time.
CHUNK = 1 << 17
#: Characters of a chunk of documents, on average.
CHARS = 1 << 23
#: Shares of the counts, and of the chunks, that are exchanged one after the other, as all at once take several times
#: the input's disk. Each share of the counts reads the texts anew.
PASSES = 2
#: Names the numbers of words of a chunk among the counts.
WORDS = 0


def _ids(text: str | None, known: dict[bytes, int] | None = None) -> Iterator[np.ndarray]:
    """64-bit hashes of the words (ASCII lower case, split at ASCII white space), with the last word of the part before."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    known = {} if known is None else known
    last = 0
    for at in range(0, len(words), CHUNK):
        part = words[at:at + CHUNK]
        out = np.empty(len(part) + 1, np.uint64)
        out[0] = last
        for w in set(part):
            if w not in known:
                known[w] = xxh64_intdigest(w, 1)
        out[1:] = np.fromiter(map(known.__getitem__, part), np.uint64, len(part))
        last = int(out[-1])
        yield out


def _cells(ids: np.ndarray, word_bits: int = 64, pair_bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of each word, of the word before it, and of the pair; the first word of a text follows a zero."""
    word = ids >> np.uint64(64 - word_bits)
    pair = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    pair ^= pair >> np.uint64(31)
    pair *= np.uint64(0x94D049BB133111EB)
    return word[1:], word[:-1], pair >> np.uint64(64 - pair_bits)


def _read(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and pairs of all texts, one after the other, and the number of words of each."""
    known: dict[bytes, int] = {}
    words, pairs, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], []
    for t in texts:
        cells = [_cells(p) for p in _ids(t, known)]
        sizes.append(sum(len(c[0]) for c in cells))
        words += [c[0] for c in cells]
        pairs += [c[2] for c in cells]
    return np.concatenate(words), np.concatenate(pairs), np.array(sizes, np.int64)


def _tally(names: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names, where each name stands among them, and (2, names) counts: background, target."""
    at, kinds = pd.factorize(names)
    return kinds, at, np.stack([np.bincount(at, minlength=len(kinds)), np.bincount(at[target], minlength=len(kinds))]).astype(np.int64)


def learn(docs: DataFrame, kept: Kept) -> DataFrame:
    """(chunk, name, n, m): counts over all rows of (chunk, text, target) of each name that other chunks hold as well.

    A name that only one chunk holds is counted there. ``WORDS`` has the numbers of words, for each chunk.
    """

    def counted(share: int):
        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            words, pairs, sizes = _read(pdf["text"])
            target = np.repeat(pdf["target"].to_numpy(bool), sizes)
            out = [np.array([[WORDS], [len(target)], [target.sum()]], np.int64)] if share == 0 else []
            for names in (words, pairs):
                mine = names % np.uint64(PASSES) == share
                kinds, _, counts = _tally(names[mine], target[mine])
                out.append(np.vstack([kinds.view(np.int64), counts]))
            name, n, m = np.concatenate(out, axis=1)
            return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "name": name, "n": n, "m": m})

        return count

    shares = []
    for share in range(PASSES):
        rows = docs.select("chunk", "text", "target").groupBy("chunk").applyInPandas(counted(share), "chunk int, name long, n int, m int")
        same = W.partitionBy("name")  # at most one row for each chunk
        rows = rows.select("chunk", "name", F.sum("n").over(same).alias("n"), F.sum("m").over(same).alias("m"), F.count("*").over(same).alias("chunks"))
        shares.append(kept.keep(rows.filter((F.col("chunks") > 1) | (F.col("name") == WORDS)).drop("chunks")))
        kept.tidy()
    out = shares[0]
    for more in shares[1:]:
        out = out.unionByName(more)
    return out


def _losses(w: np.ndarray, p: np.ndarray, words: np.ndarray, pairs: np.ndarray, totals: np.ndarray, target: bool, kinds: int) -> tuple[int, float | None, float | None]:
    """(words, target loss, background loss) in nats a word of a text, left out of the counts; w and p: places of its words and pairs."""
    n = len(w)
    if not n:
        return 0, None, None
    _, at_w, each_w = np.unique(w, return_inverse=True, return_counts=True)
    _, at_p, each_p = np.unique(p, return_inverse=True, return_counts=True)
    own_w, own_p = each_w[at_w], each_p[at_p]
    match = max(1.0, float(totals[1]))  # words that both models are brought to
    out = []
    for m in (1, 0):
        minus = 1 if m == 0 or target else 0
        total = max(0.0, float(totals[m]) - minus * n)
        scale = match / total if total else 0.0
        cw = scale * (words[m, w] - minus * own_w)
        cv = np.concatenate([[0.0], cw[:-1]])
        cp = scale * (pairs[m, p] - minus * own_p)
        one = (cw + SMOOTH * match / kinds) / (match * (1 + SMOOTH))
        out.append(float(-np.log((np.minimum(cp, cv) + BACKOFF * one) / (cv + BACKOFF)).mean()))
    return n, out[0], out[1]


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words, target_loss, background_loss, score) of each whole text; ``targets`` holds ids of the target.

    score = target_loss - background_loss in nats a word: the lower, the more like the target. Null and
    wordless texts have no words and null losses. Null ids are never target; repeated rows count as often as
    they occur; other columns are not looked at. Without a target document all scores stem from smoothing.
    """
    wanted = targets.select(F.col(id_col).alias("wanted")).filter("wanted is not null").distinct()
    id_type = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chars = docs.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)))).first()[0] or 0
    kinds = 1 << max(LEAST_BITS, int(np.ceil(np.log2(max(1, chars / 6 / WORDS_PER_KIND)))))
    chunk = F.pmod(F.xxhash64("id", "text"), F.lit(-(-chars // CHARS) or 1)).cast("int").alias("chunk")
    docs = docs.join(broadcast_if_small(settled(wanted)), F.col("id") == F.col("wanted"), "left")
    docs = docs.select(chunk, F.col("id").cast("string").alias("id"), "text", F.col("wanted").isNotNull().alias("target"))  # null ids would turn long ones into floats in pandas
    kept = Kept(docs.sparkSession)
    counts = learn(docs, kept)

    def scored(pdf: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"id": [], "words": [], "target_loss": [], "background_loss": []})
        words, pairs, sizes = _read(pdf["text"])
        target = np.repeat(pdf["target"].to_numpy(bool), sizes)
        names = shared["name"].to_numpy(np.int64).view(np.uint64)
        given = np.stack([shared["n"].to_numpy(np.int64), shared["m"].to_numpy(np.int64)])
        totals = given[:, np.flatnonzero(names == WORDS)[0]]
        places, tables = [], []
        for some in (words, pairs):
            kinds_, at, table = _tally(some, target)
            to = pd.Index(kinds_).get_indexer(names)
            table[:, to[to >= 0]] = given[:, to >= 0]
            places.append(at)
            tables.append(table)
        ends = np.cumsum(sizes)
        rows = [_losses(places[0][e - n:e], places[1][e - n:e], *tables, totals, bool(t), kinds) for e, n, t in zip(ends, sizes, pdf["target"])]
        return pd.DataFrame(rows, columns=["words", "target_loss", "background_loss"]).astype({"target_loss": float, "background_loss": float}).assign(id=pdf["id"].to_numpy())[["id", "words", "target_loss", "background_loss"]]

    done = []
    for share in range(PASSES):
        mine = F.col("chunk") % PASSES == share
        out = docs.filter(mine).groupBy("chunk").cogroup(counts.filter(mine).groupBy("chunk")).applyInPandas(scored, "id string, words long, target_loss double, background_loss double")
        done.append(kept.keep(out))
        kept.tidy()
    kept.only(*done)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.select(F.col("id").cast(id_type).alias(id_col), "words", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("target_loss", "background_loss")])
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.filter("quality = 1").select("doc_id"))
