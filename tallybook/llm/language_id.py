"""Operator 10: language identification by error-correcting output codes.

Each language has a codeword of +1 and -1, far from all others. For each place of the codewords a
binary n-gram classifier, naive Bayes on hashed n-grams of one to three bytes, predicts its sign. The
loss of a language is the sum over the places of exp(-sign * prediction), weighted by how well that
place's classifier tells that language's own n-grams; the language with the least loss is the answer,
and one whose runner-up is close is flagged as ambiguous.

The classifiers come from n-gram counts over all labelled rows, each document with the same weight;
counts and their shares are whole numbers, so every order of adding them gives the same model. Labels are all
values of lang that are not null on a row with a text; a language's n-grams are added up by the task that has it, and the driver gets the
classifiers' sums and a number for each language and place of the codewords. Of languages with the same loss the first by code point is the answer.

Null texts and texts without a letter (Unicode's, so neither digits nor fractions) are ``und`` with score 0, as is
every text when no row has a label. An empty table gives an empty result. Repeated rows give repeated results; other columns are ignored,
whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, map_rows, slices, stored, texts

ORDERS = (1, 2, 3)
BUCKETS = 4096
FEATURES = BUCKETS * len(ORDERS)
UNIT = 1_000_000
FOLDS = 5
LEAST_CODE = 15
#: Up to this many languages all pairs of codewords are compared when they are drawn; beyond, they are longer and only have to differ.
COMPARED = 1024
#: An n-gram's share of a language's text is counted in this many parts.
PARTS = 1 << 40
AMBIGUOUS = 0.1
#: What may be a letter: also numbers that are no digits.
LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters in lower case, other ASCII as spaces, all else as it is.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
BLOCK = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams, in BUCKETS places for each order; whole words and their edges, whatever the length."""
    plain = b" ".join(text.encode().translate(PLAIN).split())
    out = np.zeros(FEATURES, np.int64)
    data = b" " + plain + b" "
    reach = max(ORDERS) - 1
    for i in range(0, len(data), BLOCK):
        b = np.frombuffer(data[i : i + BLOCK + reach], np.uint8).astype(np.uint32)
        h = np.zeros(len(b), np.uint32)
        for k, order in enumerate(ORDERS):
            h = h[: len(b) - order + 1] * np.uint32(2654435761) + b[order - 1 :] + np.uint32(order) if len(b) >= order else h[:0]
            own = h[: min(BLOCK, len(data) - i - order + 1)]
            out[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount((own * np.uint32(2246822519)) >> np.uint32(20), minlength=BUCKETS)
    return out


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # languages x places
    weights: np.ndarray  # features x places
    scale: np.ndarray  # places
    trust: np.ndarray  # languages x places


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1 from a fixed seed, the best of many draws by least distance of rows; no column is constant where n > 1."""
    if n < 2:
        return np.ones((n, LEAST_CODE))
    width = max(LEAST_CODE, 4 * int(np.ceil(np.log2(n))) + 7)
    draw, best, most = np.random.default_rng(10), None, -1.0
    if n > COMPARED:
        best = np.where(draw.random((n, 2 * width)) < 0.5, -1.0, 1.0)
        while len(np.unique(best, axis=0)) < n:
            best = np.where(draw.random((n, 2 * width)) < 0.5, -1.0, 1.0)
        return best
    for _ in range(200 if n <= 64 else 5):
        c = np.where(draw.random((n, width)) < 0.5, -1.0, 1.0)
        flat = np.abs(c.sum(axis=0)) == n
        c[0, flat] *= -1
        apart = (width - c @ c.T) / 2
        np.fill_diagonal(apart, width)
        if apart.min() > most:
            best, most = c, apart.min()
    return best


def language_counts(labelled: DataFrame) -> DataFrame:
    """lang, feature, n: weighted n-gram counts of all labelled rows, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = ngram_counts(text)
                if lang not in sums:
                    sums[lang] = np.zeros(FEATURES, np.int64)
                sums[lang] += counts * UNIT // max(1, counts[:BUCKETS].sum())
        for lang, own in sums.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(own[some], pa.int64())], ["lang", "feature", "n"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """Each language with the share of each n-gram of an order in its text, in PARTS. Rows: lang, feature, n, those of a language together."""
    lang, own = None, None

    def shares() -> np.ndarray:
        total = np.maximum(own.reshape(len(ORDERS), BUCKETS).sum(axis=1), 1)
        return (own.reshape(len(ORDERS), BUCKETS).astype(float) * (PARTS / total[:, None])).astype(np.int64).ravel()

    for batch in batches:
        names, features, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b and names[a] != lang:
                if own is not None:
                    yield lang, shares()
                lang, own = names[a], np.zeros(FEATURES, np.int64)
            if a < b:
                own[features[a:b]] += counts[a:b]
    if own is not None:
        yield lang, shares()


def fit(docs: DataFrame) -> Model:
    """From the rows that are not held out and have a label and a text. The driver gets a number for each feature and place, and for each language and place."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = stored(gathered(language_counts(labelled), 1))
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    codes = codewords(len(languages))
    plus, width = {x: codes[i] > 0 for i, x in enumerate(languages)}, codes.shape[1]
    ordered = counts.repartition("lang").sortWithinPartitions("lang")

    def side_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width + 1, FEATURES), np.int64)  # of the languages with a plus at each place, and of all
        for lang, share in by_language(batches):
            sums[:width][plus[lang]] += share
            sums[width] += share
        place, feature = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(feature, pa.int32()), pa.array(sums[place, feature], pa.int64())], ["place", "feature", "n"])

    table = ordered.mapInArrow(side_sums, "place int, feature int, n bigint").groupBy("place", "feature").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((width + 1, FEATURES))
    sums[table.column("place").to_numpy(), table.column("feature").to_numpy()] = table.column("n").to_numpy() / PARTS
    floor, sizes = 1e-5, (codes > 0).sum(axis=0)
    mean = lambda side, n: side / np.maximum(n, 1)[:, None]
    weights = np.log((mean(sums[:width], sizes) + floor) / (mean(sums[width] - sums[:width], len(languages) - sizes) + floor)).T
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def margins_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, share in by_language(batches):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([(share / PARTS) @ shared.value], pa.list_(pa.float64()))], ["lang", "margins"])

    found = {r["lang"]: r["margins"] for r in ordered.mapInArrow(margins_of, "lang string, margins array<double>").collect()}
    margins = np.array([found[x] for x in languages]).reshape(len(languages), width)
    scale = np.maximum(np.abs(margins).mean(axis=0), 1e-9) if len(languages) else np.ones(width)
    trust = np.maximum(margins * codes / scale, 0.05)
    return Model(languages, codes, weights, scale, trust)


def predict(model: Model, text: str) -> tuple[str, float, bool]:
    """(language, score, ambiguous)."""
    if not model.languages or not has_letter(text):
        return "und", 0.0, False
    counts = ngram_counts(text)
    total = np.maximum(counts.reshape(len(ORDERS), BUCKETS).sum(axis=1), 1)
    share = (counts.reshape(len(ORDERS), BUCKETS) / total[:, None]).ravel()
    some = np.flatnonzero(counts)
    signs = np.clip(share[some] @ model.weights[some] / model.scale, -4, 4)
    loss = (model.trust * np.exp(-model.codes * signs)).sum(axis=1) / model.trust.sum(axis=1)
    order = np.argsort(loss, kind="stable")
    best = loss[order[0]]
    second = loss[order[1]] if len(loss) > 1 else np.inf
    likely = 1 / np.maximum(loss, 1e-12)
    return model.languages[order[0]], float(likely[order[0]] / likely.sum()), bool(best > (1 - AMBIGUOUS) * second)


def predict_languages(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred, score and ambiguous of every text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        rows = [predict(own, t) for t in texts(batch, "__text")]
        lang, score, flag = zip(*rows) if rows else ([], [], [])
        columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(flag, pa.bool_())]
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *columns], [*keep, "lang_pred", "score", "ambiguous"])

    return map_rows(docs.select(*keep, docs["text"].alias("__text")), run, f"{fields}, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document, by a model of the rows that are not held out."""
    return predict_languages(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
