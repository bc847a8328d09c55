r"""Quality rules and line labelling.

Base rules count words, their characters, symbols, repeated lines and words in
repeated three-word windows. The method then labels every line of a text as
content or boilerplate: a linear-chain conditional random field with two
states scores each line's features and each change of state, and Viterbi
decoding finds the best labels. The share of words in content lines decides
whether the text is kept.

The field is trained on documents that carry a quality label, about
TRAIN_DOCS of them at most, of at most TRAIN_LINES lines and TRAIN_CHARS
characters each, drawn by a hash of their ids. All lines of a good
document count as content, save those that repeat an earlier line, and all
lines of a bad one as boilerplate; several documents are joined to a sequence,
so that changes occur. Without labels of both kinds every line is content.

Words are runs without space or the characters from tab to carriage return.

Edge cases: a null text has no words and no lines; a text of no words fails
the base rules; each row gives one row, also for repeated rows and null ids
(which are never trained on); ties between labels go to content; an empty table
gives an empty table; extra columns are ignored, whatever their names. Texts of
any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hash_fraction, slices_by_bytes

TRAIN_DOCS = 2000
TRAIN_LINES = 400
TRAIN_CHARS = 100_000
SEQUENCE_DOCS = 20
ROUNDS = 120
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent
CONTENT_SHARE = 0.5

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SYMBOLS = re.compile(r"[#*$%&|<>]").findall
FEATURES = ("bias", "symbols", "symbol_words", "upper", "marks", "long_words", "few_words", "repeats", "seen", "ended")


def line_features(words: list[str], n_symbols: int, n_chars: int, seen: bool, line: str) -> tuple[float, ...]:
    """Numbers from 0 to 1, in the order of FEATURES."""
    n = len(words)
    if not n:
        return (1.0,) + (0.0,) * (len(FEATURES) - 1)
    return (
        1.0,
        n_symbols / n_chars,
        min(1.0, n_symbols / n),
        sum(map(str.isupper, words)) / n,
        min(1.0, line.count("!!") / n),
        min(1.0, n_chars / n / 20),
        1.0 if n < 4 else 0.0,
        1.0 - len(set(words)) / n,
        1.0 if seen else 0.0,
        1.0 if line.rstrip()[-1] in ".!?:;" else 0.0,
    )


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]  # numbered anew, so that products stay small
    windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[tuple[int, ...], list[int], list[tuple[float, ...]]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); words and features of each line with a word."""
    if not text:
        return (0, 0, 0, 0, 0), [], []
    earlier, by_line, features = set(), [], []
    n_symbols = n_dup = word_chars = 0
    for line in text.split("\n"):
        words = WORDS(line)
        symbols = len(SYMBOLS(line))
        n_symbols += symbols
        if words:
            chars = sum(map(len, words))
            word_chars += chars
            seen = line in earlier
            n_dup += seen
            earlier.add(line)
            by_line.append(words)
            features.append(line_features(words, symbols, chars, seen, line))
    words = list(chain.from_iterable(by_line))
    return (len(words), word_chars, n_symbols, n_dup, repeated_words(words)), [len(w) for w in by_line], features


class Field:
    """A linear-chain conditional random field of the states boilerplate (0) and content (1)."""

    def __init__(self, weights: np.ndarray, change: np.ndarray, start: np.ndarray):
        self.weights, self.change, self.start = weights, change, start

    def labels(self, features: np.ndarray) -> list[bool]:
        """True for content: the labels of the highest score, by Viterbi decoding; ties go to content."""
        gains = (features @ self.weights).tolist()  # of content over boilerplate
        (stay0, up), (down, stay1) = self.change.tolist()
        best0, best1 = self.start.tolist()
        best1 += gains[0]
        back = []
        for gain in gains[1:]:
            from0, from1 = best1 + down < best0 + stay0, best1 + stay1 < best0 + up
            back.append((0 if from0 else 1, 0 if from1 else 1))
            best0, best1 = (best0 + stay0 if from0 else best1 + down), (best0 + up if from1 else best1 + stay1) + gain
        state = int(best1 >= best0)
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return [bool(s) for s in reversed(out)]

    @classmethod
    def fit(cls, sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-3) -> Field:
        """Maximises the penalised likelihood of label sequences by adaptive gradient steps."""
        longest = max(len(y) for _, y in sequences)
        size, count = sequences[0][0].shape[1], len(sequences)
        x, y, there = np.zeros((count, longest, size)), np.zeros((count, longest), int), np.zeros((count, longest))
        for k, (features, labels) in enumerate(sequences):
            x[k, : len(labels)], y[k, : len(labels)], there[k, : len(labels)] = features, labels, 1
        total = there.sum()
        params = np.zeros(size + 6)
        mean, square = np.zeros_like(params), np.zeros_like(params)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][there[:, 1:] > 0], y[:, 1:][there[:, 1:] > 0]), 1)
        first = np.bincount(y[:, 0], minlength=2)
        true_gain = np.einsum("kt,ktf->f", y * there, x)
        for step in range(1, rounds + 1):
            weights, change, start = params[:size], params[size : size + 4].reshape(2, 2), params[size + 4 :]
            emit = np.stack([np.zeros((count, longest)), x @ weights], 2)
            ahead, behind = np.empty_like(emit), np.zeros_like(emit)
            ahead[:, 0] = start + emit[:, 0]
            for t in range(1, longest):
                ahead[:, t] = np.where(there[:, t, None] > 0, np.logaddexp(ahead[:, t - 1, :1] + change[0], ahead[:, t - 1, 1:] + change[1]) + emit[:, t], ahead[:, t - 1])
            for t in range(longest - 2, -1, -1):
                nxt = emit[:, t + 1] + behind[:, t + 1]
                behind[:, t] = np.where(there[:, t + 1, None] > 0, np.logaddexp(nxt[:, :1] + change[:, 0], nxt[:, 1:] + change[:, 1]), 0)
            norm = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            state = np.exp(ahead + behind - norm[:, None, None]) * there[:, :, None]
            pair = np.exp(ahead[:, :-1, :, None] + change + (emit + behind)[:, 1:, None, :] - norm[:, None, None, None]) * there[:, 1:, None, None]
            grad = np.concatenate([true_gain - np.einsum("kt,ktf->f", state[:, :, 1], x), (seen - pair.sum((0, 1))).ravel(), first - state[:, 0].sum(0)]) / total - decay * params
            mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
            params = params + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        return cls(params[:size], params[size : size + 4].reshape(2, 2), params[size + 4 :])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> list[tuple[int, list[list[float]]]]:
    """(quality, features of the lines) of the bounded sample of labelled documents."""
    usable = labels.filter(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(quality_col).cast("int").alias("quality"))
    count = usable.count()
    if not count:
        return []
    drawn = usable.filter(hash_fraction(F.col("id"), min(1.0, TRAIN_DOCS / count), "quality")).orderBy(F.xxhash64("id"), "id", "quality").limit(2 * TRAIN_DOCS)  # one id may stand on very many rows; as few as these can be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, 1):
            features = [f if len(f := measure(t)[2]) <= TRAIN_LINES else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features, pa.list_(pa.list_(pa.float64())))], ["quality", "features"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") <= TRAIN_CHARS)
    rows = texts.join(F.broadcast(drawn), "id").select("quality", "text").mapInArrow(run, "quality int, features array<array<double>>")
    return [(r.quality, r.features) for r in rows.filter("size(features) > 0").orderBy(F.xxhash64("features"), "features", "quality").limit(2 * TRAIN_DOCS).collect()]


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    """The field, or None if the labels are not of both kinds. Documents follow each other in a mixed but fixed order."""
    rows = sorted(training_rows(docs, labels), key=lambda r: (hash((r[0], len(r[1]), tuple(r[1][0]))), r[0], r[1]))
    if len({bool(q) for q, _ in rows}) < 2:
        return None
    seen, sequences = FEATURES.index("seen"), []
    for k in range(0, len(rows), SEQUENCE_DOCS):
        own = rows[k : k + SEQUENCE_DOCS]
        features = np.array([f for _, lines in own for f in lines])
        labels_ = np.array([int(bool(q) and not f[seen]) for q, lines in own for f in lines])
        sequences.append((features, labels_))
    return Field.fit(sequences)


RESULT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, content_lines bigint, boilerplate_lines bigint, content_share double"


def label(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document's id, its counts, its lines by label, and the share of its words in content lines (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                counts, sizes, features = measure(text)
                marks = field.labels(np.array(features)) if field and features else [True] * len(sizes)
                content = sum(s for s, m in zip(sizes, marks) if m)
                rows.append((*counts, sum(marks), len(marks) - sum(marks), content / counts[0] if counts[0] else None))
            columns = [pa.array(c, pa.float64() if k == 7 else pa.int64()) for k, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.int64())] * 7 + [pa.array([], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *[c.split()[0] for c in RESULT.split(", ")]])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)


def with_verdict(labelled: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return labelled.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("content_share") >= CONTENT_SHARE, F.lit(False)))
