"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features are densities of two lexicons (a fixed list of insults, and stems learnt from the labels), how near hits are
to second-person words, and rates of capitals, punctuation and obfuscation. The learnt lexicon holds words and word
beginnings far more frequent in toxic documents than in others: languages inflect, and a stem is one entry whatever
follows it. A document used to learn entries would see its own words come back, so the sample is halved and each half
gets its features from the other half's entries. Everything is fitted on a bounded sample: at most FIT_TOXIC toxic and
FIT_CLEAN other labelled documents, weighted back to their shares. Trees and calibration are Spark ML's.

Defined cases: a null text is an empty text, with all rates 0; without labels of both kinds the score is the share of
label 1 (0.0 without any); repeated rows score alike; columns of the input with any name are kept by `with_score`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetgraph.llm import chars
from sheetgraph.llm.common import cut, fold, table, text_chunks
from sheetgraph.llm.labelled import sample

FIT_TOXIC = 4_000
FIT_CLEAN = 8_000
THRESHOLD = 0.3
#: The least share of the sample's toxic documents that has an entry of the learnt lexicon, and the least log odds.
SUPPORT = 0.004
LOG_ODDS = 2.0
STRONG = 4.0
STEM = range(3, 10)
NEAR = 5
INSULTS = frozenset(
    "asshole bastard bitch clown cretin crap cunt damn disgusting dumb fool fuck fucking garbage hate idiot imbecile jerk kill "
    "loser moron pathetic pig retard scum shit shut slut stupid trash ugly vermin whore worthless "
    "arschloch abschaum blöd dumm dummkopf dreck drecksau ekelhaft fresse hure idioten miststück scheiße schwein trottel versager wertlos "
    "abruti batard connard connasse con crétin débile dégage enculé imbécile merde minable ordure pourriture putain salope salaud stupide "
    "asqueroso basura cabrón cerdo estúpido gilipollas idiota imbécil inútil maldito mierda pendejo perra puta tonto".split()
)
SECOND_PERSON = frozenset("you your yours u ur du dich dir dein deine euch euer ihr tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
LEET = str.maketrans("0134578@$!", "oieastbasi")
WORDS = re.compile(r"[^\W\d_]+")
N_FEATURES = 14


def entries_of(text: str) -> set[str]:
    """`=word` for each word and `stem` for each beginning of a word."""
    words = set(WORDS.findall(text.lower()))
    out = {"=" + w for w in words}
    for n in STEM:
        out.update(w[:n] for w in words if len(w) > n)
    return out


@dataclass
class Lexicon:
    """Log odds of learnt entries; what a word scores is remembered up to a bound."""

    odds: dict[str, float] = field(default_factory=dict)
    known: dict[str, float] = field(default_factory=dict)

    def __call__(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            get = self.odds.get
            got = max(get("=" + word, 0.0), *(get(word[:n], 0.0) for n in STEM if n < len(word)), 0.0)
            self.known[word] = got
        return got


def features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    out = np.zeros((len(texts), N_FEATURES))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(np.concatenate([[0], size[:-1] + 1])) if len(texts) else size
    code = np.minimum(chars.code_points("\n".join(texts) + "\n"), 0xFFFF)
    kind = chars.classes()[code]
    count = lambda flags: chars.counts(flags, starts, starts + size)
    upper, lower, digit, mark = (count(kind == k) for k in (chars.UPPER, chars.LOWER, chars.DIGIT, chars.MARK))
    loud = count((code == ord("!")) | (code == ord("?")))
    letter = (kind == chars.UPPER) | (kind == chars.LOWER) | (kind == chars.LETTER)
    odd = (kind == chars.DIGIT) | np.isin(code, [ord(c) for c in "@$*!"])
    hidden = np.zeros(len(kind), bool)
    hidden[1:-1] = letter[:-2] & odd[1:-1] & letter[2:]
    masked = count(hidden)
    big = np.zeros(len(kind), bool)
    big[1:] = (kind[1:] == chars.UPPER) & (kind[:-1] == chars.UPPER)
    shouted = count(big)
    for i, text in enumerate(texts):
        low = text.lower()
        words = WORDS.findall(low.translate(LEET) if masked[i] else low)
        n = max(len(words), 1)
        odds = np.fromiter(map(lexicon, words), np.float64, len(words))
        fixed = np.fromiter(map(INSULTS.__contains__, words), bool, len(words))
        hits = np.flatnonzero(fixed | (odds >= STRONG))
        you = np.flatnonzero(np.fromiter(map(SECOND_PERSON.__contains__, words), bool, len(words))) if len(hits) else hits
        near = 0
        if len(hits) and len(you):
            k = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(hits - you[np.maximum(k - 1, 0)]), np.abs(you[np.minimum(k, len(you) - 1)] - hits))
            near = int((gap <= NEAR).sum())
        out[i, :8] = fixed.sum() / n, (odds >= STRONG).sum() / n, (odds >= LOG_ODDS).sum() / n, odds.sum() / n, np.log1p(len(hits)), odds.max(initial=0), near / n, np.log1p(n)
    size = np.maximum(size, 1)
    out[:, 8:] = np.stack([upper / np.maximum(upper + lower, 1), loud / size, mark / size, masked / size, digit / size, shouted / size], axis=1)
    return out


def learn_entries(docs: DataFrame) -> tuple[Lexicon, Lexicon, Lexicon]:
    """Lexicons of half 0, of half 1 and of both, from (text, y, half).

    First the entries frequent enough in the sample's toxic documents (as the sample is bounded, so are they), then how
    often they are in the others. Every entry of the least odds is kept.
    """
    n = {(r["half"], r["y"]): r["n"] for r in docs.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    toxic = n.get((0, 1), 0) + n.get((1, 1), 0)
    shared = None

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: dict[int, Counter] = {0: Counter(), 1: Counter()}
        only = shared.value if shared is not None else None
        for pdf in batches:
            for text, half in zip(pdf["text"], pdf["half"], strict=True):
                found = entries_of(text or "")
                tally[half].update(found if only is None else found & only)
        for half, c in tally.items():
            keys = list(c)
            for k in range(0, len(keys), 50_000):
                part = keys[k : k + 50_000]
                yield pd.DataFrame({"entry": part, "half": half, "n": [c[x] for x in part]})

    schema = "entry string, half int, n long"
    per_half = [F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)]
    count = lambda y: docs.where(F.col("y") == y).select("text", "half").mapInPandas(counted, schema).groupBy("entry").agg(*per_half)
    least = max(3, SUPPORT * toxic)
    frequent = count(1).where(F.col("n0") + F.col("n1") >= least).toPandas()
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(frequent["entry"]))
    both = frequent.merge(count(0).toPandas(), on="entry", how="left", suffixes=("_t", "_c")).fillna(0)
    out = []
    for halves in ((0,), (1,), (0, 1)):
        t, c = sum(both[f"n{h}_t"] for h in halves), sum(both[f"n{h}_c"] for h in halves)
        nt, nc = sum(n.get((h, 1), 0) for h in halves), sum(n.get((h, 0), 0) for h in halves)
        odds = np.log((t + 0.5) / (nt + 1)) - np.log((c + 0.5) / (nc + 1))
        kept = both.assign(odds=odds)[(odds >= LOG_ODDS) & (t >= least * len(halves) / 2)]
        out.append(Lexicon(dict(zip(kept["entry"], kept["odds"], strict=True))))
    return tuple(out)


@dataclass
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    prior: float


def _features_udf(spark, lexicons: list[Lexicon]):
    shared = spark.sparkContext.broadcast([x.odds for x in lexicons])

    @F.pandas_udf("array<double>")
    def udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = [Lexicon(odds) for odds in shared.value]
        for texts, which in batches:
            out = np.zeros((len(texts), N_FEATURES))
            for k in which.unique():
                at = np.flatnonzero(which.to_numpy() == k)
                for first, chunk in text_chunks(texts.iloc[at].tolist()):
                    out[at[first : first + len(chunk)]] = features(chunk, own[k])
            yield pd.Series(list(out))

    return udf


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: (doc_id, toxic), only of rows to learn from."""
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    rows = cut(sample(docs, labels, "toxic", FIT_CLEAN, FIT_TOXIC).select("doc_id", "text", "y", "weight", half.alias("half")))
    total = rows.agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("y")).alias("t"), F.count_distinct("y").alias("k")).first()
    prior = total["t"] / total["w"] if total["w"] else 0.0
    if total["k"] < 2:
        return Model(Lexicon(), None, None, prior)
    lex0, lex1, both = learn_entries(rows)
    made = _features_udf(docs.sparkSession, [lex1, lex0])("text", "half")
    train = cut(rows.select("doc_id", F.col("y").cast("double").alias("y"), "weight", array_to_vector(made).alias("x")).coalesce(6))
    fitting = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) != 0
    gbt = GBTClassifier(
        featuresCol="x", labelCol="y", weightCol="weight", maxIter=20, maxDepth=3, stepSize=0.3, minInstancesPerNode=3, seed=7,
        predictionCol="_tox_class",
    )
    gbt = gbt.setRawPredictionCol("_tox_raw").setProbabilityCol("_tox_p")
    trees = gbt.fit(train.where(fitting))
    # Rows that the trees were not fitted on show what their values are worth; too small a sample has to do with all.
    unseen = train.where(~fitting)
    unseen = unseen if unseen.select("y").distinct().count() == 2 else train
    p = trees.transform(unseen).select("y", "weight", vector_to_array("_tox_p")[1].alias("p"))
    curve = IsotonicRegression(featuresCol="p", labelCol="y", weightCol="weight", predictionCol="_tox_iso").fit(p)
    trees = trees.setFeaturesCol("_tox_x")
    return Model(both, trees, curve.setFeaturesCol("_tox_p1"), prior)


def with_score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """docs and the calibrated probability that a text is toxic; a column of that name is replaced, others are kept."""
    kept = [F.col("_tox_row")[c].alias(c) for c in docs.columns if c.lower() != name.lower()]
    if model.trees is None:
        return docs.select(F.struct("*").alias("_tox_row")).select(*kept, F.lit(float(model.prior)).alias(name))
    x = _features_udf(docs.sparkSession, [model.lexicon])(F.col(text), F.lit(0))
    out = model.trees.transform(docs.select(F.struct("*").alias("_tox_row"), array_to_vector(x).alias("_tox_x")))
    out = model.curve.transform(out.select("_tox_row", vector_to_array("_tox_p")[1].alias("_tox_p1")))
    return out.select(*kept, F.least(F.greatest("_tox_iso", F.lit(0.0)), F.lit(1.0)).alias(name))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    out = with_score(docs, model).select("doc_id", held_out.alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
