"""Document quality from a linear-chain conditional random field over lines.

Method: every line is labelled good or bad. A line's evidence is what it and its two neighbours look
like (case, symbols, repetition, lengths, each cut into fixed bins); a transition ties neighbouring
labels. Forward-backward gives the marginal of every line, and their mean, weighted by length, is
the document's quality after a logistic calibration.

The model is fitted on the driver on a bounded sample of labelled documents, every line bearing its
document's label. Scoring is a function of the text alone and runs as an Arrow function per batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veritab.llm import words as W

#: Bounds of the fitting sample: so many labelled documents, none with more lines than this.
SAMPLE_DOCUMENTS = 6000
SAMPLE_LINES = 2000
THRESHOLD = 0.7
#: Code points that a task looks at at once.
CHUNK = 400_000
STEPS, RATE, RIDGE = 250, 0.2, 2e-5

SHARES = [0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.6]
#: Each feature of a line with the upper edges of its bins.
FEATURES: dict[str, list[float]] = {
    "characters": [0, 10, 30, 60, 120, 250, 500, 1000],
    "words": [0, 1, 3, 8, 20, 50, 120, 300],
    "upper": SHARES,
    "digits": SHARES,
    "symbols": SHARES,
    "bars": SHARES,
    "exclaims": SHARES,
    "stops": SHARES,
    "repeats": SHARES,
    "old_words": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8],
    "word_length": [1, 2, 3, 4, 5, 6, 8, 12],
    "short_words": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8],
    "copies": [0, 1, 2, 4, 8, 16, 32, 64],
    "ends": [0.0],
}
BINS = 9
NEIGHBOURS = (0, -1, 1)
#: Bin of a neighbour that does not exist.
OUTSIDE = BINS
WIDTH = len(NEIGHBOURS) * len(FEATURES) * (BINS + 1)


@cache
def _upper_case() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if unicodedata.category(chr(i)) == "Lu"]] = True
    return table


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of every line (lines x features), its weight, and the first line of each text.

    Lines end at line feeds; every text has at least one, an empty one if need be.
    """
    points, starts = W.code_points([t + "\n" for t in texts])
    end = np.flatnonzero(points == 0x0A)
    begin = np.concatenate([[0], end[:-1] + 1])
    first = np.searchsorted(begin, starts)
    size = (end - begin).astype(np.float64)

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (total[end] - total[begin]).astype(np.float64)

    kind = W.classes()[points]
    letters = np.maximum(per_line(kind == W.LETTER), 1)
    visible = np.maximum(per_line(kind != W.SPACE), 1)
    stops = np.isin(points, [ord(c) for c in ".,;:?"])
    exclaims, bars = points == ord("!"), points == ord("|")
    quiet = np.isin(points, [ord(c) for c in "'\"()-–’"])
    symbols = (kind == W.OTHER) & ~stops & ~exclaims & ~bars & ~quiet

    space = kind == W.SPACE
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = np.concatenate([[0], edge]) if len(points) and not space[0] else edge
    word_begin, word_end = edge[0::2], edge[1::2]
    hashes = W.word_hashes(points, word_begin, word_end)
    line = np.searchsorted(begin, word_begin, side="right") - 1
    n_lines = len(begin)
    words = np.bincount(line, minlength=n_lines).astype(np.float64)
    many = np.maximum(words, 1)
    again = np.zeros(len(line), bool)
    for back in (1, 2):
        again[back:] |= (hashes[back:] == hashes[:-back]) & (line[back:] == line[:-back])
    order = np.lexsort((hashes, line))
    old = np.zeros(len(line), bool)
    old[1:] = (hashes[order][1:] == hashes[order][:-1]) & (line[order][1:] == line[order][:-1])
    length = (word_end - word_begin).astype(np.float64)

    text = np.repeat(np.arange(len(texts)), np.diff(first))
    same = np.unique(np.stack([text.astype(np.uint64), W.word_hashes(points, begin, end)]), axis=1, return_inverse=True, return_counts=True)
    copies = np.where(size > 0, same[2][same[1].ravel()] - 1, 0)
    last = points[np.maximum(end - 1, 0)]

    def by_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(line, weights=values, minlength=n_lines)

    values = {
        "characters": size,
        "words": words,
        "upper": per_line(_upper_case()[points]) / letters,
        "digits": per_line(kind == W.NUMBER) / visible,
        "symbols": per_line(symbols) / visible,
        "bars": per_line(bars) / visible,
        "exclaims": per_line(exclaims) / visible,
        "stops": per_line(stops) / many,
        "repeats": by_word(again) / many,
        "old_words": np.bincount(line[order], weights=old, minlength=n_lines) / many,
        "word_length": by_word(length) / many,
        "short_words": by_word(length <= 3) / many,
        "copies": copies,
        "ends": (size > 0) & np.isin(last, [ord(c) for c in ".!?:;\"”»"]),
    }
    bins = np.stack([np.searchsorted(edges, values[name], side="left") for name, edges in FEATURES.items()], axis=1)
    return bins.astype(np.int16), size + 1, first


def evidence_index(bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weight numbers that are on for every line: its own bins and those of its neighbours."""
    n, k = bins.shape
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.empty((n, len(NEIGHBOURS), k), np.int32)
    for j, step in enumerate(NEIGHBOURS):
        at = np.arange(n) + step
        inside = (at >= 0) & (at < n)
        inside &= text[np.clip(at, 0, n - 1)] == text
        seen = np.where(inside[:, None], bins[np.clip(at, 0, n - 1)], OUTSIDE)
        out[:, j] = (j * k + np.arange(k)[None, :]) * (BINS + 1) + seen
    return out.reshape(n, -1)


def marginals(emission: np.ndarray, transition: np.ndarray, first: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected number of each transition if ``pairs``.

    ``emission`` is the log-odds of good, ``transition`` the 2 x 2 log-weights. Texts are handled
    side by side, the longest first, one line of each at a time.
    """
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    local = np.stack([np.exp(-np.logaddexp(0, emission)), np.exp(-np.logaddexp(0, -emission))], axis=1)
    step = np.exp(transition - transition.max())
    forward = np.empty_like(local)
    backward = np.ones_like(local)
    longest = int(count[0]) if len(count) else 0
    live = np.searchsorted(-count, -np.arange(longest), side="left")  # texts with more lines than t
    for t in range(longest):
        at = begin[: live[t]] + t
        value = local[at] if t == 0 else (forward[at - 1] @ step) * local[at]
        forward[at] = value / value.sum(axis=1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        ahead = local[at + 1] * backward[at + 1]
        if pairs:
            joint = forward[at][:, :, None] * step[None] * ahead[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        value = ahead @ step.T
        backward[at] = value / value.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), expected


@dataclass
class Model:
    weights: np.ndarray
    transition: np.ndarray
    slope: float
    offset: float

    def raw(self, bins: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Logit of the length-weighted mean marginal of every text."""
        good, _ = marginals(self.weights[evidence_index(bins, first)].sum(axis=1), self.transition, first)
        mean = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, texts: list[str]) -> np.ndarray:
        """P(label 1) of every text."""
        if not texts:
            return np.zeros(0)
        bins, weight, first = line_features(texts)
        return 1 / (1 + np.exp(-(self.slope * self.raw(bins, weight, first) + self.offset)))


def fit(bins: np.ndarray, weight: np.ndarray, first: np.ndarray, label: np.ndarray) -> Model:
    """Penalised likelihood of the lines' labels by gradient steps; both labels weigh alike."""
    index = evidence_index(bins, first)
    count = np.diff(first)
    line_label = np.repeat(label, count).astype(np.float64)
    model = Model(np.zeros(WIDTH), np.zeros((2, 2)), 1.0, 0.0)
    if not len(label):
        return model
    seen = np.zeros((2, 2))
    for value in (0, 1):
        seen[value, value] = (count[label == value] - 1).sum()
    n = len(line_label)
    square_w, square_t = np.zeros(WIDTH), np.zeros((2, 2))
    for _ in range(STEPS):
        good, expected = marginals(model.weights[index].sum(axis=1), model.transition, first, pairs=True)
        gradient = np.bincount(index.ravel(), weights=np.repeat((line_label - good) / n, index.shape[1]), minlength=WIDTH)
        gradient -= RIDGE * model.weights
        turn = (seen - expected) / n - RIDGE * model.transition
        square_w += gradient**2
        square_t += turn**2
        model.weights += RATE * gradient / np.sqrt(square_w + 1e-12)
        model.transition += RATE * turn / np.sqrt(square_t + 1e-12)
    model.slope, model.offset = calibrate(model.raw(bins, weight, first), label)
    return model


def calibrate(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on one number, by Newton steps with a small penalty."""
    x = np.stack([raw, np.ones_like(raw)], axis=1)
    theta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (label - p) - 1e-2 * theta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        move = np.linalg.solve(curve, gradient)
        theta += np.clip(move, -2, 2)
    return float(theta[0]), float(theta[1])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label, and the bins and weights of the lines of each text, some texts at once: a batch may hold thousands."""
    for batch in batches:
        for a, b, texts in W.text_chunks(batch.column("_text"), CHUNK):
            bins, weight, first = line_features(texts)
            cut = list(zip(first[:-1].tolist(), first[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id")[a:b].cast(pa.int64()),
                    batch.column("label")[a:b].cast(pa.int32()),
                    pa.array([bins[x:y].tobytes() for x, y in cut], pa.binary()),
                    pa.array([weight[x:y].tobytes() for x, y in cut], pa.binary()),
                ],
                ["id", "label", "bins", "weight"],
            )


def fit_on(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCUMENTS) -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out, drawn by a hash of the id.

    Labels that are null or contradict each other are left out. Texts stay on the executors; the
    driver gets the bins of their lines. Without any label every text scores 0.5.
    """
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(id_col).agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
        .filter("label = most").select(id_col, "label").orderBy(F.xxhash64(id_col), id_col).limit(sample)
    )
    text = documents.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = text.filter(F.size(F.split("_text", "\n")) <= SAMPLE_LINES)
    rows = text.join(F.broadcast(chosen), id_col)  # at most ``sample`` rows

    rows = rows.select(F.col(id_col).alias("id"), "label", "_text")
    found = rows.mapInArrow(_line_rows, "id long, label int, bins binary, weight binary").toArrow().sort_by("id")
    if not found.num_rows:
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), 1.0, 0.0)
    bins = np.frombuffer(b"".join(found["bins"].to_pylist()), np.int16).reshape(-1, len(FEATURES))
    weights = [np.frombuffer(w, np.float64) for w in found["weight"].to_pylist()]
    first = np.concatenate([[0], np.cumsum(list(map(len, weights)))])
    return fit(bins, np.concatenate(weights), first, found["label"].to_numpy())


def score_column(model: Model, text_col: str = "text") -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.score(some) for _, _, some in W.text_chunks(texts, CHUNK)]
        return pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return score(F.col(text_col))


def classify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    A null text scores like an empty one: one empty line. Repeated rows score alike. A null id is
    not held out. Nothing but the text enters a score.
    """
    scored = documents.select(id_col, held_out(id_col).alias("held_out"), score_column(model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that score at least ``threshold``, with all their columns."""
    return documents.filter(score_column(model, text_col) >= threshold)
