"""Document quality by a linear-chain conditional random field over lines.

Every line has two states, good and bad. Its score comes from its own features and those of the lines before and
after it; a 2 x 2 matrix scores neighbouring states. The field is fitted by conditional likelihood on a bounded
sample of labelled documents whose lines all take the document's label (FIT_DOCS of each label at most, documents of
at most FIT_LINES lines). Forward-backward gives each line's marginal; the marginals, weighted by the lines' lengths,
make the document's quality, which a logistic curve fitted on a part of the sample turns into a probability.

Defined cases: a null text is an empty text, which is one empty line; without labels of both kinds the score is the
share of label 1 (0.0 without any); repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetgraph.llm import chars
from sheetgraph.llm.common import fold, table, text_chunks, text_key
from sheetgraph.llm.labelled import sample

FIT_DOCS = 5_000
FIT_LINES = 128
ROUNDS = 150
STEP = 0.05
RIDGE = 1e-3
THRESHOLD = 0.3
N_BASE = 16


def base_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text, the lines' lengths, and the number of lines of each text."""
    lines, n_lines, words = [], np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        own = t.split("\n")
        n_lines[i] = len(own)
        seen: set[str] = set()
        before = None
        for line in own:
            w = line.split()
            words.append((len(w), len(set(w)), line in seen, line == before, line[-1:] in ".!?:\"'»)" and line != "", w[0][0].isupper() if w else False))
            seen.add(line)
            before = line
        lines += own
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(np.concatenate([[0], size[:-1] + 1]))
    code = np.minimum(chars.code_points("\n".join(lines) + "\n"), 0xFFFF)
    kind = chars.classes()[code]
    count = lambda flags: chars.counts(flags, starts, starts + size)
    lower, upper, digit, mark = (count(kind == k) for k in (chars.LOWER, chars.UPPER, chars.DIGIT, chars.MARK))
    is_mark = kind == chars.MARK
    runs = count(np.concatenate([[False], is_mark[1:] & is_mark[:-1]]))
    bars = count(code == ord("|"))
    loud = count((code == ord("!")) | (code == ord("?")))
    n, uniq, again, same, ended, capital = (np.array(x, np.float64) for x in zip(*words, strict=True))
    letters = lower + upper
    per = lambda a, b: a / np.maximum(b, 1)
    base = np.stack(
        [
            np.log1p(size) / 5, size == 0, per(letters, size), per(upper, letters), per(digit, size), per(mark, size), per(runs, size) * 3, per(bars, n),
            per(loud, n), 1 - per(uniq, np.maximum(n, 1)) * (n > 0), np.log1p(n) / 5, per(size, n) / 10, again, same, ended, capital,
        ],
        axis=1,
    )
    return base.astype(np.float32), size, n_lines


def with_neighbours(base: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at the ends), which ends these are, and a constant."""
    last = np.cumsum(n_lines) - 1
    first = last - n_lines + 1
    before, after = np.roll(base, 1, axis=0), np.roll(base, -1, axis=0)
    before[first], after[last] = 0, 0
    ends = np.zeros((len(base), 2), np.float32)
    ends[first, 0], ends[last, 1] = 1, 1
    return np.hstack([base, before, after, ends, np.ones((len(base), 1), np.float32)])


def marginals(score: np.ndarray, n_lines: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of every line, log Z of every text, and the expected number of each pair of neighbouring states, each
    text counted by its weight (1 without any).

    score is that of `good`, `bad` has 0. All texts step forward together, longest first, so that texts that have
    ended are at the back.
    """
    order = np.argsort(-n_lines, kind="stable")
    first = (np.cumsum(n_lines) - n_lines)[order]
    size, most = n_lines[order], int(n_lines.max())
    alive = np.searchsorted(-size, -np.arange(most), side="left")
    alpha = np.zeros((len(score), 2))
    emit = np.zeros((len(score), 2))
    emit[:, 1] = score
    alpha[first] = emit[first]
    for t in range(1, most):
        at = first[: alive[t]] + t
        p = alpha[at - 1]
        alpha[at] = emit[at] + np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1])
    beta = np.zeros((len(score), 2))
    for t in range(most - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        b = beta[at + 1] + emit[at + 1]
        beta[at, 0] = np.logaddexp(trans[0, 0] + b[:, 0], trans[0, 1] + b[:, 1])
        beta[at, 1] = np.logaddexp(trans[1, 0] + b[:, 0], trans[1, 1] + b[:, 1])
    end = alpha[first + size - 1]
    log_z = np.empty(len(size))
    log_z[order] = np.logaddexp(end[:, 0], end[:, 1])
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
    inner = np.ones(len(score), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    z = np.repeat(log_z, n_lines)[at]
    pairs = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            each = np.exp(alpha[at - 1, a] + trans[a, b] + emit[at, b] + beta[at, b] - z)
            pairs[a, b] = each.sum() if weight is None else (each * np.repeat(weight, n_lines)[at]).sum()
    return good, log_z, pairs


def likelihood(x: np.ndarray, y: np.ndarray, n_lines: np.ndarray, weight: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray]:
    """Minus the conditional log likelihood of all lines having their text's label, texts counted by weight, and its
    gradient. p: weights of the features, then the four of neighbouring states."""
    trans, score = p[-4:].reshape(2, 2), x @ p[:-4]
    good, log_z, pairs = marginals(score, n_lines, trans, weight)
    y_line, w_line, inner = np.repeat(y, n_lines), np.repeat(weight, n_lines), weight * (n_lines - 1)
    have = np.array([(inner * (1 - y)).sum(), 0, 0, (inner * y).sum()])
    loss = (weight * log_z).sum() - (w_line * y_line * score).sum() - (have * p[-4:]).sum()
    return float(loss), np.concatenate([x.T @ (w_line * (good - y_line)), pairs.ravel() - have])


@dataclass
class Model:
    weights: np.ndarray | None
    trans: np.ndarray
    curve: tuple[float, float]
    prior: float


def text_quality(model: Model, base: np.ndarray, size: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean marginal."""
    good, _, _ = marginals(with_neighbours(base, n_lines) @ model.weights, n_lines, model.trans)
    cuts = np.cumsum(n_lines) - n_lines
    w = size + 1.0
    mean = np.add.reduceat(good * w, cuts) / np.add.reduceat(w, cuts)
    return np.log((mean + 1e-4) / (1 - mean + 1e-4))


def _descend(grad, x: np.ndarray, rounds: int, step: float) -> np.ndarray:
    """Adam."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: (doc_id, quality), only of rows to learn from."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, texts in text_chunks(pdf["text"].tolist()):
                base, size, n_lines = base_features(texts)
                cuts = np.cumsum(n_lines)[:-1]
                part = pdf.iloc[first : first + len(texts)]
                rows = part[["doc_id", "th", "y", "weight"]].assign(base=[b.ravel() for b in np.split(base, cuts)], size=np.split(size, cuts))
                yield rows[n_lines <= FIT_LINES]

    got = sample(docs, labels, "quality", FIT_DOCS, FIT_DOCS)
    layout = "doc_id long, th long, y int, weight double, base array<float>, size array<long>"
    rows = got.withColumn("th", text_key(F.col("text"))).mapInPandas(features, layout).toPandas().sort_values(["doc_id", "th"]).reset_index(drop=True)
    prior = float((rows["y"] * rows["weight"]).sum() / rows["weight"].sum()) if len(rows) else 0.0
    model = Model(None, np.zeros((2, 2)), (1.0, 0.0), prior)
    if rows["y"].nunique() < 2:
        return model
    held = np.arange(len(rows)) % 4 == 3  # rows alike in id and text are alike in all, so their order says nothing
    parts = []
    for part in (rows[~held], rows[held]):
        base = np.concatenate([np.asarray(b, np.float32) for b in part["base"]]).reshape(-1, N_BASE)
        size = np.concatenate([np.asarray(s) for s in part["size"]])
        parts.append((base, size, part["size"].map(len).to_numpy(), part["y"].to_numpy(float), part["weight"].to_numpy()))
    base, _, n_lines, y, weight = parts[0]
    x = with_neighbours(base, n_lines).astype(np.float64)
    scale = (weight * n_lines).sum()

    def grad(p: np.ndarray) -> np.ndarray:
        return likelihood(x, y, n_lines, weight, p)[1] / scale + RIDGE * p

    p = _descend(grad, np.zeros(x.shape[1] + 4), ROUNDS, STEP)
    model = Model(p[:-4], p[-4:].reshape(2, 2), (1.0, 0.0), prior)
    base, size, n_lines, y, weight = parts[1]
    if len(set(y)) == 2:
        odds = text_quality(model, base, size, n_lines)
        q = lambda c: 1 / (1 + np.exp(-np.clip(c[0] * odds + c[1], -40, 40)))
        curve = _descend(lambda c: np.array([(weight * (q(c) - y) * odds).mean(), (weight * (q(c) - y)).mean()]), np.array([1.0, 0.0]), 400, 0.02)
        model.curve = (max(float(curve[0]), 1e-3), float(curve[1]))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The probability that a text is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            out = np.full(len(texts), m.prior)
            for first, chunk in text_chunks(texts.tolist()) if m.weights is not None else ():
                odds = text_quality(m, *base_features(chunk))
                out[first : first + len(chunk)] = 1 / (1 + np.exp(-(m.curve[0] * odds + m.curve[1])))
            yield pd.Series(out)

    return udf(F.col(text))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
