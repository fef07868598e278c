"""Quality classifier: a linear-chain conditional random field over lines.

Every line is good or bad. Its features are byte statistics of itself and of the lines beside it; the chain's weights
and transitions are fitted by gradient ascent on a bounded sample of labelled documents, whose lines carry the label of
their document. Forward-backward gives each line's probability of being good; their mean, weighted by line length, is
mapped to a score by a logistic curve fitted on the same sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.textarrays import chunks, text_bytes, words

#: Labelled documents of each class that the model is fitted on, the first by the MD5 of their id.
SAMPLE_PER_CLASS = 1_500
STEPS = 150
PENALTY = 1e-3

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2E, 0x2C, 0x3B, 0x3A]] = True
_SYMBOL = ~(_LETTERS | _DIGIT | _SPACE | _STOP)


class Lines(NamedTuple):
    features: np.ndarray  # a row per line
    weight: np.ndarray  # bytes
    doc: np.ndarray
    count: np.ndarray  # lines per text


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of "good", for own, previous and next features and a constant
    trans: np.ndarray  # 2 x 2 log potentials, bad 0 and good 1
    slope: float
    bias: float


def line_features(column: pa.Array) -> Lines:
    """Features of every line that has a word; texts without one have no line."""
    data, offsets = text_bytes(column)
    n_docs = len(offsets) - 1
    w = words(data, offsets, fold_case=False)
    ends = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.r_[offsets[:-1][np.diff(offsets) > 0], ends + 1])
    starts = starts[starts < data.size]
    if not w.start.size:
        return Lines(np.zeros((0, 13)), np.zeros(0), np.zeros(0, np.int64), np.zeros(n_docs, np.int64))
    line = np.searchsorted(starts, w.start, "right") - 1
    n_words = np.bincount(line, minlength=len(starts))
    size = np.diff(np.r_[starts, data.size]).astype(float)

    def total(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int32), starts).astype(float)

    letters, upper, symbol = total(_LETTERS[data]), total(_UPPER[data]), total(_SYMBOL[data])
    digits, stops = total(_DIGIT[data]), total(_STOP[data])
    same_line = line[1:] == line[:-1]
    repeat = np.bincount(line[1:][same_line & (w.hash[1:] == w.hash[:-1])], minlength=len(starts))
    order = np.lexsort((w.hash, line))
    fresh = np.r_[True, (np.diff(line[order]) != 0) | (w.hash[order][1:] != w.hash[order][:-1])]
    distinct = np.bincount(line[order][fresh], minlength=len(starts))
    is_symbol = _SYMBOL[data]
    run = is_symbol.copy()
    run[1:] &= is_symbol[:-1]
    runs = total(run)
    single = np.diff(np.r_[w.start, data.size]) == 2  # a lone character and its separator
    lone = np.bincount(line[single & is_symbol[w.start]], minlength=len(starts))
    has = n_words > 0
    n = np.maximum(n_words, 1)
    ink = np.maximum(letters + digits + stops + symbol, 1)
    x = np.column_stack(
        [
            np.log1p(size),
            letters / ink,
            upper / np.maximum(letters, 1),
            symbol / ink,
            digits / ink,
            stops / n,
            runs / n,
            lone / n,
            repeat / n,
            distinct / n,
            ink / n / 10,
            n_words < 4,
            (n_words > 20) & (stops == 0),
        ]
    )
    doc = np.searchsorted(offsets, starts, "right") - 1
    return Lines(x[has], size[has], doc[has], np.bincount(doc[has], minlength=n_docs))


def _design(x: np.ndarray, doc: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Own, previous and next line's standardised features and a constant; zeros beyond a text's ends."""
    z = np.clip((x - mean) / scale, -6, 6)
    before, after = np.zeros_like(z), np.zeros_like(z)
    same = (doc[1:] == doc[:-1])[:, None]
    before[1:], after[:-1] = np.where(same, z[:-1], 0), np.where(same, z[1:], 0)
    return np.hstack([z, before, after, np.ones((len(z), 1))])


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(emit: np.ndarray, count: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line and the expected transitions of all texts; texts advance together, longest first.

    ``emit`` is the log potential of "good" a line (of "bad" it is 0), lines of a text in a row.
    """
    count = count[count > 0]
    first = np.r_[0, np.cumsum(count)[:-1]]
    order = np.argsort(-count, kind="stable")
    count, first = count[order], first[order]
    alpha = np.zeros((len(emit), 2))
    beta = np.zeros((len(emit), 2))
    pot = np.column_stack([np.zeros(len(emit)), emit])
    live = np.searchsorted(-count, -np.arange(1, (count[0] if len(count) else 0) + 1), "right")  # texts with over t lines
    for t, k in enumerate(live):
        at = first[:k] + t
        alpha[at] = pot[at] if t == 0 else pot[at] + _log_sum(alpha[at - 1][:, :, None] + trans, 1)
    for t in range(len(live) - 2, -1, -1):
        at = first[: live[t + 1]] + t
        beta[at] = _log_sum(trans + (pot[at + 1] + beta[at + 1])[:, None, :], 2)
    joint = alpha + beta
    good = 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -50, 50)))
    inner = np.ones(len(emit), bool)
    inner[first] = False
    to = np.flatnonzero(inner)
    pair = alpha[to - 1][:, :, None] + trans + (pot[to] + beta[to])[:, None, :]
    pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
    return good, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def _document_mean(good: np.ndarray, lines: Lines) -> np.ndarray:
    n = len(lines.count)
    return np.bincount(lines.doc, good * lines.weight, n) / np.maximum(np.bincount(lines.doc, lines.weight, n), 1)


def fit(lines: Lines, labels: np.ndarray) -> Model:
    """Weights by Adam on the conditional likelihood of the line labels; all lines count alike."""
    x = lines.features
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    f = _design(x, lines.doc, mean, scale)
    y = labels[lines.doc].astype(float)
    theta = np.zeros(f.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    same = lines.doc[1:] == lines.doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][same].astype(int), y[1:][same].astype(int)), 1)
    for step in range(1, STEPS + 1):
        good, pairs = marginals(f @ theta[:-4], lines.count, theta[-4:].reshape(2, 2))
        grad = np.r_[f.T @ (y - good), (seen - pairs).ravel()] / len(y) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    good, _ = marginals(f @ theta[:-4], lines.count, theta[-4:].reshape(2, 2))
    has = lines.count > 0
    s, t = _document_mean(good, lines)[has], labels[has].astype(float)
    a, b = 1.0, 0.0
    for _ in range(2000):
        p = 1 / (1 + np.exp(-(a * (s - 0.5) + b)))
        a, b = a + 2 * (np.mean((t - p) * (s - 0.5)) - 1e-4 * a), b + 2 * np.mean(t - p)
    return Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), float(a), float(b))


def score(model: Model, column: pa.Array) -> np.ndarray:
    """Document quality, 0 to 1; a text without words gets what the curve gives an even chance."""
    lines = line_features(column)
    good, _ = marginals(_design(lines.features, lines.doc, model.mean, model.scale) @ model.weights, lines.count, model.trans)
    mean = np.where(lines.count > 0, _document_mean(good, lines), 0.5)
    return 1 / (1 + np.exp(-(model.slope * (mean - 0.5) + model.bias)))


def held_out(id_col: Column) -> Column:
    """Rows kept from training: crc32 of the id's text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """Fit on at most ``per_class`` labelled documents of each class that are not held out; None without both classes."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).alias("_y")).withColumn("_o", F.md5(F.col("_id").cast("string")))
    picked = [known.where(F.col("_y") == y).orderBy("_o", "_id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]).select("_id", "_y"))  # at most 2 * per_class rows of two numbers
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t")).join(sample, "_id").select("_id", "_y", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2):
                lines = line_features(part.column(2))
                ids, ys = np.array(part.column(0)), np.array(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lines.doc]), pa.array(ys[lines.doc].astype(np.int32)), pa.array(lines.weight), pa.array(list(lines.features), pa.list_(pa.float64()))],
                    names=["id", "y", "w", "x"],
                )

    got = rows.mapInArrow(run, "id long, y int, w double, x array<double>").toPandas()
    if got["y"].nunique() < 2:
        return None
    got["n"] = np.arange(len(got))
    got = got.sort_values(["id", "n"])
    doc, first = np.unique(got["id"].to_numpy(), return_inverse=True)
    y = np.zeros(len(doc), int)
    y[first] = got["y"].to_numpy()
    return fit(Lines(np.stack(got["x"].to_numpy()), got["w"].to_numpy(), first, np.bincount(first)), y)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input column and ``score`` double of the whole text, 0 to 1.

    A column of the input named score, in any case, is replaced. Null, empty and blank texts have no line and get the curve's middle value. Without labels of both classes every
    score is 0.5. Rows with a null or repeated id are scored each; scores depend on the text alone.
    """
    model = train(docs, labels, id_col, text_col)
    kept = [f for f in docs.schema.fields if f.name.lower() != "score"]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    if model is None:
        return docs.withColumn("score", F.lit(0.5))
    names = [*docs.columns, "score"]
    text = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(model, part.column(text)))], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"])
    return docs.mapInArrow(run, schema)
