r"""Language identification by interpolated Kneser-Ney character models.

For each language a model of order ORDER predicts the letters of every word
and its end from up to ORDER - 1 characters before, within the word. Texts are
lower-cased; words are runs of letters. Spark counts the n-grams of a sample
of labelled documents; the counts become sorted arrays of 64-bit n-gram hashes
with one column of probabilities for each language. A text's cross-entropy
under a model is its negative log probability by predicted character, in nats;
the language of the lowest one wins, ties by name.

Rejection is calibrated on labelled documents kept out of the counts. A text
of LEAST_SYMBOLS characters or more is rejected if no language fits it better
than the other languages fit texts of the one predicted: if its lowest
cross-entropy is above the mean one that those texts have under the other
models, and above the highest one that they have under their own. So texts of
several languages, or with odd passages, stay. A text without letters is always
rejected, as ``und``.

The sample is bounded: about DOCS_PER_LANGUAGE documents of a language, and
about DOCS_IN_ALL altogether, drawn by a hash of their ids, of the first
SAMPLE_CHARS characters of each, and of the MAX_LANGUAGES languages that have
most documents; documents of others are predicted as one of these. A language
of few documents always has one that is counted. Predictions read all documents
whole.

The score is a share among the learned languages, so a text of a language that
was never learned can have a high one; ``rejected`` tells of those.

Edge cases: a null or empty text, or one without letters, gives ``und``, score
0, no cross-entropy; each row gives one row, also for repeated rows and null
ids (a null id is never trained on); of languages that fit equally well the
first by name is taken; a table without labelled rows gives ``und``
everywhere; an empty table gives an empty table; extra columns are ignored,
whatever their names (a kept column named like a result gets ``own_`` in
front).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, by_chars, hash_fraction, held, hidden, own, shown, slices

ORDER = 5
DOCS_PER_LANGUAGE = 1000
DOCS_IN_ALL = 20_000
SAMPLE_CHARS = 100_000
#: Each language costs a column of the models' arrays.
MAX_LANGUAGES = 256
#: One of so many sampled documents calibrates rejection.
CALIBRATION_PART = 5
#: Shorter texts say too little to reject them.
LEAST_SYMBOLS = 128
#: With one language only: standard deviations over the mean cross-entropy.
SLACK = 20.0
#: Bounds of the words that a worker remembers.
MEMO_WORDS, MEMO_CHARS = 200_000, 8_000_000
#: Words whose probabilities under all languages are added up at a time.
CHUNK_WORDS = 16_384
UNKNOWN = "und"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, text, calibrates: the bounded sample, of documents that are not held out."""
    text = F.substring(F.col(text_col), 1, SAMPLE_CHARS)
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("text"))
    drawn_by = F.xxhash64("id", F.lit("sample"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(drawn_by).alias("least")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    bound = F.least(F.lit(DOCS_PER_LANGUAGE), F.lit(DOCS_IN_ALL) / F.count(F.lit(1)).over(_all()))
    share = F.broadcast(counts.select("lang", "least", (bound / F.col("n")).alias("share")))  # MAX_LANGUAGES rows at most
    drawn = (F.pmod(drawn_by, F.lit(1_000_000)) < F.col("share") * 1_000_000) | (drawn_by == F.col("least"))
    # An id on very many rows is drawn with all of them, so a language's rows are limited as well; its first row is always counted.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0, F.xxhash64("id", F.lit("place")), "id", "text"))
    limited = usable.join(share, "lang").filter(drawn).withColumn("place", place).filter(F.col("place") <= 2 * DOCS_PER_LANGUAGE)
    return limited.select("lang", "text", ((F.col("place") > 1) & hash_fraction(F.col("id"), 1 / CALIBRATION_PART, "calibration")).alias("calibrates"))


def _all():
    return Window.partitionBy()


def gram_counts(sample: DataFrame) -> DataFrame:
    """lang, gram, n: counts of all windows of ORDER characters of words, padded in front and ended."""
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    padded = words.select("lang", "n", F.concat(F.lit("^" * (ORDER - 1)), "word", F.lit("$")).alias("padded"))
    places = F.sequence(F.lit(1), F.length("padded") - (ORDER - 1))
    grams = padded.select("lang", "n", F.explode(F.transform(places, lambda i: F.substring(F.col("padded"), i, F.lit(ORDER)))).alias("gram"))
    return grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_hash(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of code points."""
    with np.errstate(over="ignore"):
        h = np.full(points.shape[:-1], 0x9E3779B97F4A7C15 + points.shape[-1], np.uint64)
        for k in range(points.shape[-1]):
            h = (h ^ points[..., k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h


def _points(grams: list[str]) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").reshape(len(grams), -1) if grams else np.zeros((0, 1), np.uint32)


@dataclass
class Level:
    """n-grams of one order: sorted hashes, and by language the discounted share of the count; the same for contexts and the weight left to the lower order."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    left: np.ndarray


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]
    uniform: float
    keys: np.ndarray  # sorted hashes of the n-grams of the highest order that any language has
    logs: np.ndarray  # their log probabilities by language
    limits: dict[str, float] = field(default_factory=dict)

    def probability(self, points: np.ndarray) -> np.ndarray:
        """Probabilities of the last of each row's code points after the others, by language."""
        p = np.full((len(points), len(self.languages)), self.uniform)
        for n, level in enumerate(self.levels, 1):
            share, found = _look_up(level.grams, level.share, gram_hash(points[:, -n:]))
            left, seen = _look_up(level.contexts, level.left, gram_hash(points[:, -n:-1]))
            p = np.where(found[:, None], share, 0.0) + np.where(seen[:, None], left, 1.0) * p
        return p

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By word: its log probability by language, and its number of predicted characters."""
        pad = ORDER - 1
        flat = np.frombuffer("".join(["^" * pad + w + "$" for w in words]).encode("utf-32-le"), "<u4")
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(np.concatenate([[0], sizes[:-1] + pad]))
        first = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        points = np.lib.stride_tricks.sliding_window_view(flat, ORDER)[first]
        logs, found = _look_up(self.keys, self.logs, gram_hash(points))
        if not found.all():
            logs[~found] = np.log(self.probability(points[~found]))
        return np.add.reduceat(logs, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0), sizes


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros((len(wanted), values.shape[1])), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[at], keys[at] == wanted


def build(counts: dict[str, dict[str, int]]) -> Model:
    """A model from counts of n-grams of the highest order, by language."""
    languages = sorted(counts)
    symbols = {g[-1] for grams in counts.values() for g in grams}
    levels, by_lang = [], {lang: dict(counts[lang]) for lang in languages}
    for _ in range(ORDER, 0, -1):
        index, contexts = {}, {}
        for grams in by_lang.values():
            for g in grams:
                index.setdefault(g, len(index))
                contexts.setdefault(g[:-1], len(contexts))
        share, left = np.zeros((len(index), len(languages))), np.ones((len(contexts), len(languages)))
        lower: dict[str, dict[str, int]] = {}
        for k, lang in enumerate(languages):
            grams = by_lang[lang]
            once, twice = (sum(1 for c in grams.values() if c == n) for n in (1, 2))
            discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
            total, kinds, below = {}, {}, {}
            for g, c in grams.items():
                total[g[:-1]] = total.get(g[:-1], 0) + c
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
                below[g[1:]] = below.get(g[1:], 0) + 1
            for g, c in grams.items():
                share[index[g], k] = (c - discount) / total[g[:-1]]
            for c, n in kinds.items():
                left[contexts[c], k] = discount * n / total[c]
            lower[lang] = below
        grams, places = _sorted_hashes(list(index))
        context_keys, context_places = _sorted_hashes(list(contexts))
        levels.insert(0, Level(grams, share[places], context_keys, left[context_places]))
        by_lang = lower
    model = Model(languages, levels, 1 / (len(symbols) + 1), np.zeros(0, np.uint64), np.zeros((0, len(languages))))
    every = sorted({g for grams in counts.values() for g in grams})
    if every:
        model.keys, places = _sorted_hashes(every)
        model.logs = np.log(model.probability(_points(every)))[places].astype(np.float32)
    return model


def _sorted_hashes(grams: list[str]) -> tuple[np.ndarray, np.ndarray]:
    hashes = gram_hash(_points(grams)) if grams and grams[0] else gram_hash(np.zeros((len(grams), 0), np.uint32))
    places = np.argsort(hashes)
    return hashes[places], places


class Scorer:
    """A model with a memory of the words it has met; one for each Python worker."""

    def __init__(self, model: Model):
        import regex

        self.model, self.words = model, regex.compile(r"\p{L}+").findall
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.model.languages)), np.float32)
        self.sizes = np.zeros(0, np.int64)
        self.chars = 0

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """By text: log probability by language, and number of predicted characters."""
        if len(self.rows) > MEMO_WORDS or self.chars > MEMO_CHARS:
            self.forget()
        rows, flat, ends = self.rows, [], []
        for text in texts:
            flat.extend([rows.setdefault(w, len(rows)) for w in self.words(text.lower())] if text else ())
            ends.append(len(flat))
        if len(rows) > len(self.logs):
            new = list(islice(rows, len(self.logs), None))
            self.chars += sum(map(len, new))
            logs, sizes = self.model.word_scores(new)
            self.logs, self.sizes = np.concatenate([self.logs, logs.astype(np.float32)]), np.concatenate([self.sizes, sizes])
        at = np.array(flat, np.int64)
        sizes = np.diff([0, *ends])
        of_text = np.repeat(np.arange(len(texts)), sizes)
        counts = np.bincount(of_text, self.sizes[at], len(texts)).astype(np.int64) if len(at) else np.zeros(len(texts), np.int64)
        # Each distinct word of a text counts once, in chunks, so memory doesn't follow a text's length times the languages.
        keys, times = np.unique(of_text * max(1, len(rows)) + at, return_counts=True)
        of_text, at = np.divmod(keys, max(1, len(rows)))
        totals = np.zeros((len(texts), len(self.model.languages)))
        for start in range(0, len(keys), CHUNK_WORDS):
            part = slice(start, start + CHUNK_WORDS)
            first = np.flatnonzero(np.diff(of_text[part], prepend=-1))
            totals[of_text[part][first]] += np.add.reduceat(self.logs[at[part]] * times[part, None].astype(np.float64), first, axis=0)
        return totals, counts


RESULT = "lang_pred string, score double, cross_entropy double, other_entropy double, n_symbols bigint"


def _predict(docs: DataFrame, shared, extra: list[str], text_col: str) -> DataFrame:
    """extra columns of docs with RESULT; they are called otherwise than RESULT's."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("language_id", name), lambda: Scorer(shared.value))
        languages = scorer.model.languages
        for batch in slices(batches):
            langs, scores, entropies, others, sizes = [], [], [], [], []
            for chunk in by_chars(batch.column(batch.num_columns - 1).to_pylist()):
                totals, counts = scorer.totals(chunk)
                for total, n in zip(-totals, counts.tolist()):
                    sizes.append(n)
                    if n and languages:
                        h = total / n
                        best = int(h.argmin())
                        langs.append(languages[best])
                        entropies.append(float(h[best]))
                        others.append(float((h.sum() - h[best]) / (len(h) - 1)) if len(h) > 1 else None)
                        scores.append(float(1 / np.exp(-(h - h[best]) * min(n, 50)).sum()))
                    else:
                        langs.append(UNKNOWN)
                        entropies.append(None)
                        others.append(None)
                        scores.append(0.0)
            columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(entropies, pa.float64()), pa.array(others, pa.float64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*extra, "lang_pred", "score", "cross_entropy", "other_entropy", "n_symbols"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in extra)
    return docs.select(*extra, F.col(text_col).alias("__text")).mapInArrow(run, kinds + RESULT)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Models of all languages of the labelled documents that are not held out, with limits of rejection.

    What comes to the driver is bounded by the sample: its distinct n-grams.
    """
    spark = docs.sparkSession
    sample = Scratch(spark).cut(training_sample(docs, id_col, text_col, lang_col), "language-sample")
    counts: dict[str, dict[str, int]] = {}
    for lang, gram, n in gram_counts(sample.filter("not calibrates")).collect():
        counts.setdefault(lang, {})[gram] = n
    model = build(counts)
    if model.languages:
        shared = spark.sparkContext.broadcast(model)
        scored = _predict(sample.filter("calibrates"), shared, ["lang"], "text").filter(f"lang = lang_pred and n_symbols >= {LEAST_SYMBOLS}")
        h = F.col("cross_entropy")
        alone = F.avg(h) + SLACK * F.coalesce(F.stddev_pop(h), F.lit(0.0))
        limits = scored.groupBy("lang").agg(F.greatest(F.max(h), F.coalesce(F.avg("other_entropy"), alone)).alias("limit")).collect()
        model.limits = {r.lang: r.limit for r in limits}
    return model


def _identified(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """docs with hidden column names, RESULT and rejected."""
    rows = hidden(docs)
    found = _predict(rows, docs.sparkSession.sparkContext.broadcast(model), rows.columns, own(docs, text_col))
    limit = F.lit(math.inf)
    for lang, value in sorted(model.limits.items()):
        limit = F.when(F.col("lang_pred") == lang, value).otherwise(limit)
    far = (F.col("n_symbols") >= LEAST_SYMBOLS) & F.coalesce(F.col("cross_entropy") > limit, F.lit(False))
    return found.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | far)


RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")] + ["rejected"]


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns to keep of docs with RESULT and rejected."""
    kept = docs.select(*keep, F.col(text_col).alias("__text"))
    found = _identified(kept, model, "__text")
    return found.select(*[F.col(f"own{k}").alias(f"own_{c}" if c.lower() in RESULT_NAMES else c) for k, c in enumerate(keep)], *RESULT_NAMES)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected."""
    return shown(_identified(docs, model, text_col).filter("not rejected"), docs)
