"""Operator 4: SimHash fingerprints, and the search among them by permuted block tables.

Terms are the text's pairs of neighbouring words (a lone word is its own term), lower-cased. Each term's
64-bit hash votes with the weight 1 + ln(count) for the bits it has and against those it lacks; the
fingerprint has the bits whose votes are above zero. Two fingerprints that differ in d bits come from
texts whose term weights have a cosine of about cos(pi d / 64); that, not below 0, is their likeness.

``edited_fingerprints`` needs every document beside the next one in descending order of doc_id. Documents are
dealt to ranges of the order, whose bounds Spark samples, and sorted there, so texts are moved once and pass one by one; a range may be
larger than memory. What a range cannot know, the document after its last one, follows from its neighbour's
first one: these two documents of every range are kept with their texts and joined.

Null texts count as empty; texts without words have fingerprint 0. Rows with a null doc_id come last in
the order, rows with equal doc_id are ordered by a hash of their texts. A single document is its own next one. Empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices, stored, texts

#: Terms whose bits are counted at once.
BLOCK = 1 << 16
#: Documents of a range, about; more where that would be more than so many ranges.
RANGE_ROWS, MOST_RANGES = 8_000, 50_000
#: What the rows of a range are.
RESULT, FIRST, LAST = 0, 1, 2


def signed_votes(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over the hashes of +weight for each bit that is set, -weight for each that is not."""
    votes = np.zeros(64)
    for i in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += weights[i : i + BLOCK] @ bits
    return 2 * votes - weights.sum()


def packed(bits: np.ndarray) -> int:
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str) -> int:
    words = text.lower().encode().split()
    terms = Counter(zip(words, words[1:])) if len(words) > 1 else Counter([(w,) for w in words])
    if not terms:
        return 0
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(t)) for t in terms), np.uint64, len(terms))
    counts = np.fromiter(terms.values(), np.float64, len(terms))
    return packed(signed_votes(hashes, 1 + np.log(counts)) > 0)


def likeness(a: int, b: int) -> float:
    return max(0.0, math.cos(math.pi * (a ^ b).bit_count() / 64))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and the fingerprint (16 hex digits) of every text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [f"{fingerprint(t):016x}" for t in texts(batch, "__text")]
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(out, pa.string())], [*keep, "fingerprint"])

    return map_rows(docs.select(*keep, docs[text].alias("__text")), run, f"{fields}, fingerprint string")


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
FIELDS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(text: str, own: int, following: str, following_print: int) -> tuple:
    """The values of ``NAMES`` of a document and the next one."""
    new = edited(text, following)
    f = fingerprint(new)
    return len(text), hashlib.sha256(new.encode()).hexdigest(), f"{own:016x}", f"{f:016x}", likeness(own, f), likeness(own, following_print)


def ranged(docs: DataFrame) -> DataFrame:
    """kind, part, doc_id, text and ``NAMES``: of each range the results of all documents but the last, and its first and last with their texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = min(MOST_RANGES, max(1, docs.count() // RANGE_ROWS))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = docs.repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, nothing = TaskContext.get().partitionId(), None, (None,) * len(NAMES)
        kind_of_id = None
        names, kinds = ["kind", "part", "doc_id", "text", *NAMES], lambda: [pa.int8(), pa.int32(), kind_of_id, pa.string(), *KINDS]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds())], names)

        for batch in slices(batches):
            kind_of_id, rows = batch.schema.field(0).type, []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = fingerprint(text)
                if held:
                    rows.append((RESULT, part, held[0], None, *compared(held[1], held[2], text, own)))
                else:
                    rows.append((FIRST, part, doc_id, text, *nothing))
                held = doc_id, text, own
            yield table(rows)
        if held:
            yield table([(LAST, part, held[0], held[1], *nothing)])

    return dealt.mapInArrow(run, f"kind tinyint, part int, doc_id {kind}, text string, {FIELDS}")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stored(ranged(docs))
    parts = sorted(r.part for r in found.where(F.col("kind") == FIRST).select("part").collect())  # a number for each range
    neighbours = docs.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]])), "part int, after int")
    firsts = found.where(F.col("kind") == FIRST).select(F.col("part").alias("after"), F.col("text").alias("following"))
    lasts = found.where(F.col("kind") == LAST).select("part", "doc_id", "text").join(neighbours, "part").join(firsts, "after").select("doc_id", "text", "following")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [compared(a, fingerprint(a), b, fingerprint(b)) for a, b in zip(texts(batch), texts(batch, "following"))]
        columns = zip(*rows) if rows else [[] for _ in NAMES]
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, KINDS)]], ["doc_id", *NAMES])

    return found.where(F.col("kind") == RESULT).select("doc_id", *NAMES).unionByName(map_rows(lasts, run, f"doc_id {kind}, {FIELDS}"))


def block_tables(radius: int, blocks: int) -> list[int]:
    """Masks of the block tables: at most ``radius`` blocks hold a differing bit, so some table of the ``blocks - radius`` others is equal."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [sum(masks[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]


def within_radius(queries: DataFrame, stored_prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All (fingerprint, neighbour, distance) of distinct fingerprints (hex) within ``radius`` bits, equal ones left out.

    Each table permutes its blocks to the front, which here is masking them as the join key.
    """
    if not 0 <= radius < blocks:
        raise ValueError("more blocks than differing bits are needed")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = F.array(*[F.lit(signed(m)) for m in block_tables(radius, blocks)])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        value = F.conv("fingerprint", 16, -10).cast("long")
        return (
            df.select("fingerprint").distinct().select(F.col("fingerprint").alias(name), value.alias(f"{name}_bits"))
            .select(name, f"{name}_bits", F.posexplode(masks).alias("table", "mask"))
            .select(name, f"{name}_bits", "table", F.col(f"{name}_bits").bitwiseAND(F.col("mask")).alias("key"))
        )

    distance = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits")))
    return (
        keyed(queries, "a").join(keyed(stored_prints, "b"), ["table", "key"])
        .where((distance <= radius) & (distance > 0))
        .select(F.col("a").alias("fingerprint"), F.col("b").alias("neighbour"), distance.alias("distance"))
        .distinct()
    )
