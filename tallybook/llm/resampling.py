"""Operator 11: importance resampling towards a target, ranked by parallel sorting by regular sampling.

Runs of one to three words of a text are counted in a fixed array of buckets. The counts of all source texts
and all target texts give each bucket a gain, the logarithm of how much likelier it is in the target, as a whole number; a
document's weight is the sum of the gains of its runs. Random noise from its key (Gumbel's, so that the
highest scores are a sample without replacement by weight) makes the weight a score.

Exact ranks come from parallel sorting by regular sampling: every task sorts its own run of rows and numbers
them; rows at regular places of all runs are the samples, and of these, sorted, regular ones are the splitters. Each row goes
to the segment between its splitters, segments are sorted for themselves, and the counts of the segments before give
its rank. Equal rows are told apart by run and place, so a segment holds no more than two steps between samples of each
run beyond its share, whatever repeats. The driver gets the samples, a bounded number for a segment and one for a run, and the segments' counts.

Null texts have no words: no runs, weight 0. A null key counts as the empty text in the hash and comes last among equals. Rows of equal
key and score follow each other in any order. Repeated rows count as often as they stand. Empty tables give
empty results; an empty target leaves the smoothing alone. Other columns are ignored, whatever they are called. Texts are read
in pieces, so a long one needs no more than its own bytes.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, slices, stored, texts

BUCKETS = 10_000
LONGEST_RUN = 3
SEED = "42"
LEAST_WORDS = 20
#: Drawn: this many hundredths of the documents with enough words.
DRAWN = 5
#: Rows of a segment of the sort, at most about twice as many, and samples for each.
SEGMENT_ROWS, SAMPLES = 1 << 20, 16
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
#: Small letters for A-Z; digits, letters and all bytes beyond ASCII stay; the rest parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
SPACE = re.compile(b" ")


def word_lists(text: str) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    data, at = text.encode().translate(WORD_BYTES), 0
    while at < len(data):
        m = SPACE.search(data, at + PIECE)
        end = m.end() if m else len(data)
        yield data[at:end].split()
        at = end


def bucket_counts(text: str) -> tuple[np.ndarray, int]:
    """(how many runs of the text fall into each bucket, its number of words)."""
    out, n = np.zeros(BUCKETS, np.int64), 0
    tails: list[list[int]] = [[] for _ in range(LONGEST_RUN - 1)]  # checksums of the runs that the next piece's words carry on
    for words in word_lists(text):
        if not words:
            continue
        n += len(words)
        sums = list(map(crc32, words))
        spaced, level, first = [b" " + w for w in words], [sums], 0
        for k in range(LONGEST_RUN - 1):  # a run of one word more: the checksum carried on, from the first word that ends such a run
            before = tails[k] + level[-1]
            first += not tails[k]
            tails[k] = before[-1:]
            level.append(list(map(crc32, spaced[first:], before)))
        for own in level:
            out += np.bincount(np.fromiter(own, np.uint32, len(own)) % BUCKETS, minlength=BUCKETS)
    return out, n


def table_counts(docs: DataFrame) -> np.ndarray:
    """The runs of all texts by bucket, summed in each task first; the driver gets a number for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            for text in texts(batch):
                total += bucket_counts(text)[0]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural logarithm of how much likelier each bucket is in the target, rounded down."""
    whole_s, whole_t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(float(t + 1) * whole_s / (float(s + 1) * whole_t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(key: Column, seed: str = SEED) -> Column:
    """Thousandths of Gumbel noise from the key's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, gains: np.ndarray, key: str = "doc_id") -> DataFrame:
    """key, n_features, n_words, weight of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [bucket_counts(t) for t in texts(batch)]
            columns = [[int(c.sum()) for c, _ in found], [n for _, n in found], [int(c @ gains) for c, _ in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], [key, "n_features", "n_words", "weight"])

    return docs.select(docs[key], docs["text"].alias("text")).mapInArrow(run, f"`{key}` {kind}, n_features bigint, n_words bigint, weight bigint")


def ranked(rows: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """The rows with their rank (from 1) by ascending keys of whole numbers, by parallel sorting by regular sampling. Nulls are not allowed in keys."""
    spark, names = rows.sparkSession, [f"__k{i}" for i in range(len(keys))]
    keyed = rows.withColumns(dict(zip(names, [k.cast("long") for k in keys])))
    # every task sorts its run; the number of a row holds its run and its place there
    runs = stored(gathered(keyed).sortWithinPartitions(*names).withColumn("__at", F.monotonically_increasing_id()))
    n = runs.count()
    if not n:
        return runs.drop(*names, "__at").withColumn(name, F.lit(None).cast("long"))
    segments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / SEGMENT_ROWS))
    step = max(1, n // (segments * SAMPLES))
    place = F.col("__at").bitwiseAND((1 << 33) - 1)
    samples = sorted(map(tuple, runs.where(place % step == step // 2).select(*names, "__at").collect()))
    splitters = sorted({samples[i * len(samples) // segments] for i in range(1, segments)}) if samples else []
    order = [*names, "__at"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(*(batch.column(c).to_pylist() for c in order))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bisect_right(splitters, x) for x in own], pa.int32())], [*batch.schema.names, "__segment"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    dealt = runs.mapInArrow(deal, f"{fields}, __segment int")
    inside = F.row_number().over(Window.partitionBy("__segment").orderBy(*order))
    sorted_segments = stored(gathered(dealt.withColumn("__within", inside)))
    sizes = sorted_segments.groupBy("__segment").count().orderBy("__segment").collect()  # a row for each segment
    bases, before = [], 0
    for r in sizes:
        bases.append((r["__segment"], before))
        before += r["count"]
    offsets = F.broadcast(spark.createDataFrame(bases, "__segment int, __base bigint"))
    found = sorted_segments.join(offsets, "__segment")
    return found.select(*rows.columns, (F.col("__base") + F.col("__within")).alias(name))


def resample(docs: DataFrame, target: DataFrame, drawn: int = DRAWN, least_words: int = LEAST_WORDS, seed: str = SEED, key: str = "doc_id") -> DataFrame:
    """key, n_features, weight, score, rank of every document: drawn are ``drawn`` hundredths of those with ``least_words``, by highest score; rank is null for the others. target: text."""
    gains = bucket_gains(table_counts(docs), table_counts(target))
    scored = weighed(docs, gains, key).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    scored = stored(scored)
    fit = F.col("n_words") >= least_words
    kind = scored.schema[key].dataType.simpleString()
    own = F.coalesce(F.col(key), F.lit(0)) if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(key)
    ordered = ranked(scored.where(fit), [-F.col("score"), F.col(key).isNull().cast("int"), own])
    most = drawn * scored.where(fit).count() // 100
    out = [key, "n_features", "weight", "score"]
    taken = ordered.select(*out, F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
    return taken.unionByName(scored.where(~fit).select(*out, F.lit(None).cast("long").alias("rank")))


def drawn_texts(docs: DataFrame, target: DataFrame, **given) -> DataFrame:
    """The drawn documents themselves, with rank; of rows with one key all if one is drawn, each once."""
    key = given.get("key", "doc_id")
    found = resample(docs, target, **given).where("rank is not null").groupBy(key).agg(F.min("rank").alias("rank"))
    return docs.join(found, key)
