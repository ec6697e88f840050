"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; everything but letters is a blank, and runs of blanks count as one. N-grams of 1 to 4
characters are hashed to BUCKETS columns. Counting runs over every training document, one counter per task, summed
by Spark; the matrix of log probabilities (languages x BUCKETS, so of fixed width) is broadcast, and batches are
scored by gathering its rows in numpy.

Defined cases: a null text, or one without a letter, is `und` with score 0.0; documents with a null lang are not
learnt from; without any training document everything is `und`; a tie goes to the language first by code point;
repeated rows are predicted alike; more than MOST_LANGS values of lang raise an error. The score is the posterior of the predicted language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetgraph.llm.common import fold, table, text_chunks

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
PAD = " " * max(ORDERS)
#: Languages a model may have: its matrix then takes MOST_LANGS x BUCKETS x 4 bytes at most.
MOST_LANGS = 512
#: N-grams that are scored at once.
SLICE = 1 << 16
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points of the basic plane are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
    return _letters


def ngrams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """[(positions, hashes) for each order], the position where each text begins, and which texts have a letter."""
    low = [t.lower() for t in texts]
    starts = np.cumsum([0] + [len(t) + len(PAD) for t in low])
    codes = np.frombuffer((PAD.join(low) + PAD).encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = letters()[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        alpha[i] = chr(codes[i]).isalpha()
    codes = np.where(alpha, codes, 32).astype(np.uint32)
    out = []
    for n in ORDERS:
        h = np.full(len(codes) - n + 1, n, np.uint32)
        for k in range(n):
            h += codes[k : len(codes) - n + 1 + k]
            h *= _MULT[k % len(_MULT)]
            h ^= h >> np.uint32(15)
        solid = alpha[n - 1 :] if n == 1 else alpha[n - 1 :] | alpha[n - 2 : -1]
        if n > 2:  # no two blanks side by side
            for k in range(n - 2):
                solid = solid & (alpha[k : k + len(solid)] | alpha[k + 1 : k + 1 + len(solid)])
        at = np.flatnonzero(solid)
        out.append((at, (h[at] & np.uint32(BUCKETS - 1)).astype(np.intp)))
    has = np.add.reduceat(alpha, starts[:-1], dtype=np.int64) > 0 if texts else np.zeros(0, bool)
    return out, starts, has


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    seen: dict[str, int] = {}
    for pdf in batches:
        for lang, group in pdf.groupby("lang"):
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            seen[lang] = seen.get(lang, 0) + len(group)
            for _, texts in text_chunks(group["text"].tolist()):
                for _, h in ngrams(texts)[0]:
                    own += np.bincount(h, minlength=BUCKETS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1).astype(np.int32), "n": np.append(own[at], seen[lang])})


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    logp: np.ndarray  # BUCKETS x languages, float32


def fit(docs: DataFrame) -> Model:
    """Learn from every row of docs with a text and a lang."""
    known = docs.where("text is not null and lang is not null").select("text", "lang")
    if known.select("lang").distinct().limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} values of lang: these are no languages")
    sums = known.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    logp, prior = np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = sums[sums["lang"] == lang]
        grams = own[own["bucket"] >= 0]
        n = np.zeros(BUCKETS)
        n[grams["bucket"].to_numpy()] = grams["n"].to_numpy()
        logp[:, k] = np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS))
        prior[k] = own.loc[own["bucket"] == -1, "n"].sum()
    return Model(langs, np.log(prior / max(prior.sum(), 1)) if langs else prior, logp)


def _score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return names, scores
    for first, chunk in text_chunks(texts):
        orders, starts, has = ngrams(chunk)
        total = np.tile(model.prior, (len(chunk), 1))
        for at, h in orders:
            if not len(at):
                continue
            for k in range(0, len(at), SLICE):
                doc = np.searchsorted(starts, at[k : k + SLICE], side="right") - 1
                new = np.flatnonzero(np.diff(doc, prepend=-1))
                total[doc[new]] += np.add.reduceat(model.logp[h[k : k + SLICE]], new, axis=0, dtype=np.float64)
        best = total.argmax(1)
        p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        for i in np.flatnonzero(has):
            names[first + i] = model.langs[best[i]]
            scores[first + i] = p[i]
    return names, scores


def predict(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct (lang_pred, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = _score(shared.value, texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return udf(F.col(text))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = fit(docs.where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), predict(docs, model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
