"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text becomes lower-case words of letters with a blank at both ends.  Every run of 2 to 5 UTF-8 bytes inside
a word and its blanks is hashed to one of ``BUCKETS`` embeddings; their mean goes through a
linear softmax.  Training is plain stochastic gradient descent over pieces of labelled texts.  A fifth of the sample is kept
out of it and sets the temperature of the softmax (scores are then probabilities one can
trust) and the threshold below which a prediction is rejected.  Embeddings that no training piece touched are
zero, so unknown writing pulls the mean to zero, the score to 1 / languages, and is rejected.

The fit reads a bounded sample: ``SAMPLE_DOCS`` documents per language, of each up to ``SAMPLE_CHARS`` characters from a
place that its id picks, by one task; languages beyond the ``LANGUAGES`` most frequent are not learned.
Predictions read whole texts.  Since the layer is linear, embeddings and softmax weights are multiplied out
to one row of scores per bucket for the prediction; the result is the same.

Defined results: a text that is null or has no letter gets ``und`` and score 0, and so does every text when there is nothing to
learn from.  Equal scores go to the language that sorts first.  Rows with null language are predicted but not learned
from.  Repeated rows are predicted alike; an empty table gives no rows.  ``predict`` keeps further columns but for
those it adds, which replace columns of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import odd_numbers, packs, staged

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
_FACTOR = odd_numbers(1, 11)[0]
DIMENSIONS = 16
SIZES = (2, 3, 4, 5)
SAMPLE_DOCS = 300
SAMPLE_CHARS = 2_000
LANGUAGES = 200
UNDECIDED = "und"
#: Share of the accepted calibration pieces that must be right, and share of the right ones that may be rejected.
PRECISION, LOST = 0.995, 0.01
EPOCHS, BATCH, RATE, SEED = 3, 64, 0.5, 7
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def words_only(text: str) -> bytes:
    """Lower-case words with single blanks around them."""
    return f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace")


def subwords(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size: the buckets of all subwords of the texts, in order, and how many each text has."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    blank = data == 32
    code = data.astype(np.uint64)
    good, out = np.ones(len(data), bool), []
    for size in range(2, max(SIZES) + 1):
        n = max(0, len(data) - size + 1)
        code = code[:n] * np.uint64(257) + data[size - 1 :] if n else code[:0]
        good = good[:n]
        if size > 2 and n:  # no blank inside, so none reaches into another text either
            good = good & ~blank[size - 2 : size - 2 + n]
        kept = good & ~(blank[:n] & blank[1 : n + 1]) if size == 2 and n else good
        if size in SIZES:
            found = np.flatnonzero(kept)
            buckets = ((code[found] * np.uint64(8) + np.uint64(size)) * _FACTOR >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            out.append((buckets, np.diff(np.searchsorted(found, bounds))))
    return out


def mean_rows(rows: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], count: int) -> np.ndarray:
    """Mean of the rows of each text's subwords; zero where there is none."""
    total, sizes = np.zeros((count, rows.shape[1])), np.zeros(count, np.int64)
    for buckets, counts in found:
        some = np.flatnonzero(counts)
        sizes += counts
        if not len(some):
            continue
        starts = (np.cumsum(counts) - counts)[some]
        if rows.shape[1] > 16:
            total[some] += np.add.reduceat(rows[buckets], starts, axis=0, dtype=np.float64)
        else:
            for i in range(rows.shape[1]):
                total[some, i] += np.add.reduceat(rows[:, i][buckets], starts, dtype=np.float64)
    return total / np.maximum(sizes, 1)[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    #: buckets x languages: embeddings times softmax weights.
    scores: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return softmax(mean_rows(self.scores, subwords(texts), len(texts)) / self.temperature)


def pieces(text: str, rng: np.random.Generator) -> Iterator[str]:
    """A text in pieces of 3 to 60 words, so that short texts are learned too."""
    words = text.split()
    at = 0
    while at < len(words):
        size = int(rng.integers(3, 61))
        yield " ".join(words[at : at + size])
        at += size


def train(texts: list[str], labels: list[str], kept_out: list[bool]) -> Model | None:
    """Fit on the texts that are not ``kept_out``; calibrate on the others."""
    rng = np.random.default_rng(SEED)
    languages = sorted({lang for lang, out in zip(labels, kept_out) if not out})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    sets: tuple[list, list] = ([], [])
    for text, lang, out in zip(texts, labels, kept_out):
        if lang in number:
            sets[bool(out)].extend((words_only(p), number[lang]) for p in pieces(text, rng) if has_letter(p))
    fit, held = sets
    embeddings = np.asfortranarray(rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)))
    weights = np.zeros((DIMENSIONS, len(languages)))
    touched = np.zeros(BUCKETS, bool)
    steps, step = max(1, EPOCHS * -(-len(fit) // BATCH)), 0
    # every language weighs the same, however many pieces it has
    share = np.bincount([y for _, y in fit], minlength=len(languages)).astype(float)
    weight = share.sum() / np.maximum(share, 1) / max(1, np.count_nonzero(share))
    for _ in range(EPOCHS if fit else 0):
        order = rng.permutation(len(fit))
        for lo in range(0, len(fit), BATCH):
            batch = [fit[i] for i in order[lo : lo + BATCH]]
            rate, step = RATE * (1 - step / steps), step + 1
            found = subwords([t for t, _ in batch])
            y = np.array([y for _, y in batch])
            hidden = mean_rows(embeddings, found, len(batch))
            error = softmax(hidden @ weights)
            error[np.arange(len(batch)), y] -= 1
            error *= weight[y][:, None]
            sizes = np.maximum(sum(counts for _, counts in found), 1)
            back = rate * (error @ weights.T) / sizes[:, None]
            weights -= rate * hidden.T @ error
            buckets = np.concatenate([b for b, _ in found])
            owners = np.concatenate([np.repeat(np.arange(len(batch)), counts) for _, counts in found])
            touched[buckets] = True
            for d in range(DIMENSIONS):
                embeddings[:, d] -= np.bincount(buckets, back[owners, d], BUCKETS)
    embeddings[~touched] = 0
    model = Model(languages, np.asfortranarray(embeddings @ weights, np.float32))
    if held:
        calibrate(model, [t for t, _ in held], np.array([y for _, y in held]))
    return model


def calibrate(model: Model, texts: list[bytes], y: np.ndarray) -> None:
    """Temperature with the least log loss, and the rejection threshold."""
    logits = mean_rows(model.scores, subwords(texts), len(texts))
    grid = np.geomspace(0.05, 5, 60)
    losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    p = softmax(logits / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    enough = np.flatnonzero(precision >= PRECISION)
    by_precision = score[order][enough[-1]] if len(enough) else 1.0
    few = np.quantile(score[right], LOST) if right.any() else 1.0
    # chance level is never accepted
    model.threshold = float(max(by_precision, few, 1.5 / (len(model.languages) + 0.5)))


def fit_languages(docs: DataFrame, labelled: Column, key: Column, text: str = "text", lang: str = "lang") -> Model | None:
    """A model from a bounded sample of the rows where ``labelled`` holds; ``key`` picks the sample and its fifth for calibration."""
    rows = docs.where(labelled & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(key.cast("string")).alias("key")
    )
    known = rows.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES)
    known = F.broadcast(docs.sparkSession.createDataFrame(known.collect(), "lang string, rows long"))
    # four times the wanted rows by their hash, then the first of them
    share = 4 * SAMPLE_DOCS * 2**20
    few = rows.join(known, "lang").where((F.pmod("key", F.lit(2**20)) * F.col("rows") < F.lit(share)) & F.col("text").isNotNull())
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    part = F.substring(F.col("text"), (F.pmod(F.shiftright("key", 20), room) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    first = Window.partitionBy("lang").orderBy("key", "text")
    few = few.select("lang", part.alias("text"), "key").withColumn("place", F.row_number().over(first))
    sample = staged(few.where(F.col("place") <= SAMPLE_DOCS), "language-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("lang", "key", "text"))))
        places: dict[str, int] = {}
        kept_out = []
        for language, _, _ in taken:
            places[language] = places.get(language, -1) + 1
            kept_out.append(places[language] % 5 == 4)
        model = train([t for *_, t in taken], [g for g, *_ in taken], kept_out)
        if model is not None:
            yield pa.RecordBatch.from_pydict({
                "languages": [model.languages], "scores": [model.scores.T.tobytes()],
                "temperature": [model.temperature], "threshold": [model.threshold],
            })

    found = sample.repartition(1).mapInArrow(run, "languages array<string>, scores binary, temperature double, threshold double").collect()
    if not found:
        return None
    row = found[0]
    scores = np.frombuffer(bytes(row["scores"]), np.float32).reshape(len(row["languages"]), BUCKETS).T
    return Model(list(row["languages"]), scores, row["temperature"], row["threshold"])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and accepted (score at or above the model's threshold)."""
    added = ["lang_pred", "score", "accepted"]
    kept = [c for c in docs.columns if c not in added]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = held.value
        for batch in packs(batches, text):
            texts = batch.column(text).to_pylist()
            some = [i for i, t in enumerate(texts) if now is not None and has_letter(t)]
            lang, score, accepted = [UNDECIDED] * len(texts), [0.0] * len(texts), [False] * len(texts)
            if some:
                p = now.probabilities([words_only(texts[i]) for i in some])
                for i, best, value in zip(some, p.argmax(axis=1), p.max(axis=1)):
                    lang[i], score[i], accepted[i] = now.languages[best], float(value), bool(value >= now.threshold)
            columns = [batch.column(c) for c in kept] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=kept + added)

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return docs.select(*kept).mapInArrow(run, schema)
