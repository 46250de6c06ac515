"""Operator 6: removal of repeated line chunks with content-defined boundaries.

Every line is hashed. A rolling hash over the last three line hashes decides where a chunk of lines
ends, so boundaries depend on nearby lines only and shift along with them. A line of ``LONG_WORDS``
words or more counts as many lines and always stands as a chunk of its own. Chunks of two lines or
more (or one such long line) that have ``MIN_WORDS`` words are looked up in the whole corpus; the
first of equal chunks (least doc_id, then position) stays, the others are removed with their lines.

A repeated passage of few lines may hold no such chunk from end to end. So the smallest chunks, every two neighbouring
lines (blank ones between them go along), are looked up as well; they only tell how far a passage goes: a stretch of lines
each two of which stand somewhere before is removed if it has ``LONG_WORDS`` words. The first occurrence of a line
is in no chunk that has an earlier one, so no line is lost from the corpus.

Chunks meet by a 128-bit hash; only those whose hashes repeat are gathered with their text, and are
equal only if their bytes are: grouping is by the text itself. A filter keeps most other chunks out of that
step; it never decides, has one bit in eight set, and where there are more repeated hashes than ``FILTER_KEYS`` the
texts are gathered in rounds, each for its share of them.

Null texts count as empty. Rows with equal doc_id and text are one document. Empty tables give empty
results; columns with other names are carried along by ``dedup_lines`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

LONG_WORDS = 50
MIN_WORDS = 20
WINDOW = 3
#: One boundary in so many lines, on average; and the most lines of a chunk.
DIVISOR, MOST_LINES = 4, 32
#: Repeated hashes that one filter takes, with eight bits for each: 64 MB at most.
FILTER_KEYS = 1 << 26
#: The two kinds of chunks.
CHUNK, PAIR = 0, 1
MASK = (1 << 64) - 1
MULTIPLIER = 0x9E3779B97F4A7C15


def line_chunks(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, line after the last) of the chunks that may be removed."""
    found = []
    start, words, recent = 0, 0, []

    def close(end: int) -> None:
        if end - start >= 2 and words >= MIN_WORDS:
            found.append((start, end))

    for i, line in enumerate(lines):
        n = line.count(" ") + 1 if line else 0
        if n >= LONG_WORDS and (n := len(line.split())) >= LONG_WORDS:
            close(i)
            found.append((i, i + 1))
            start, words, recent = i + 1, 0, []
            continue
        words += n
        recent = [*recent[1 - WINDOW :], xxhash.xxh3_64_intdigest(line)]
        rolling = 0
        for h in recent:
            rolling = (rolling * MULTIPLIER + h) & MASK
        if i - start >= 1 and (rolling >> 32) % DIVISOR == 0 or i - start + 1 >= MOST_LINES:
            close(i + 1)
            start, words = i + 1, 0
    close(len(lines))
    return found


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def line_pairs(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, line after the last) of every two neighbouring lines that are not blank."""
    full = [i for i, line in enumerate(lines) if line and not line.isspace()]
    return [(i, j + 1) for i, j in zip(full, full[1:])]


def chunk_rows(docs: DataFrame, seen=None, hash_bits: int = 128) -> DataFrame:
    """doc_id, rid, kind, pos, h1, h2 of every chunk; with ``seen`` (a broadcast filter and its share of h1) only of those it may hold, and their text."""
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    with_text = seen is not None
    cut = (1 << hash_bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, rounds, own = seen.value if with_text else (b"", 1, 0)
        mask = len(bits) * 8 - 1
        for batch in slices(batches):
            origin, kinds, pos, h1, h2, chunk = [], [], [], [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                lines = text.split("\n")
                coded = [line.encode() for line in lines]
                for kind, found in ((CHUNK, line_chunks(lines)), (PAIR, line_pairs(lines))):
                    for a, b in found:
                        body = b"\n".join(coded[a:b])
                        h = xxhash.xxh3_128_intdigest(body, kind) & cut
                        one = h & MASK
                        if with_text:
                            place = (one >> 1) // rounds & mask
                            if (one >> 1) % rounds != own or not bits[place >> 3] >> (place & 7) & 1:
                                continue
                            chunk.append(body)
                        origin.append(row)
                        kinds.append(kind)
                        pos.append(a)
                        h1.append(signed(one))
                        h2.append(signed(h >> 64))
            at = pa.array(origin, pa.int32())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(kinds, pa.int8()), pa.array(pos, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())]
            names = ["doc_id", "rid", "kind", "pos", "h1", "h2"]
            if with_text:
                columns.append(pa.array(chunk, pa.binary()))
                names.append("chunk")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "rid", "text").mapInArrow(run, f"doc_id {kind_of_id}, rid bigint, kind tinyint, pos int, h1 bigint, h2 bigint" + ", chunk binary" * with_text)


def filters(hashes: DataFrame) -> Iterator:
    """Broadcast (filter of the low bits, number of rounds, round): together they hold all h1, a share of FILTER_KEYS each."""
    n = hashes.count()
    rounds = -(-n // FILTER_KEYS)
    bits = max(1 << 15, 1 << (8 * min(n, FILTER_KEYS)).bit_length())
    for own in range(rounds):
        key = F.shiftrightunsigned("h1", 1)
        share = hashes.where(F.pmod(key, F.lit(rounds)) == own)
        place = F.expr(f"shiftrightunsigned(h1, 1) div {rounds}").bitwiseAND(F.lit(bits - 1)) + 1
        rows = share.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toLocalIterator()
        out = bytearray(bits // 8)
        for r in rows:
            out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
        yield hashes.sparkSession.sparkContext.broadcast((bytes(out), rounds, own))


def removals(docs: DataFrame, hash_bits: int = 128) -> DataFrame:
    """doc_id, rid, gone, gone_pairs (first lines of the chunks that have an earlier equal one) of the documents that have some. docs: doc_id, rid, text."""
    place = F.struct("doc_id", "rid", "pos")
    instances = stored(chunk_rows(docs, None, hash_bits))
    repeated = stored(instances.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b or (a.doc_id is null) <> (b.doc_id is null)").select("h1", "h2"))
    same = None
    for seen in filters(repeated):
        # Equal only if the bytes are: grouping is by the text itself.
        by_text = chunk_rows(docs, seen, hash_bits).groupBy("h1", "h2", "chunk").agg(F.min(place).alias("keeper"), F.count("*").alias("n"))
        share = by_text.groupBy("h1", "h2").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("keeper").alias("keeper")).where("n > 1")
        share = stored(share)
        same = share if same is None else same.unionByName(share)
    if same is None:
        return instances.limit(0).groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("gone"), F.collect_set("pos").alias("gone_pairs"))
    # With one text for both hashes in the corpus, the instances have its very bytes.
    earlier = instances.join(same.where("texts = 1").select("h1", "h2", "keeper"), ["h1", "h2"])
    several = same.where("texts > 1").select("h1", "h2")
    if several.take(1):  # different texts under one hash: told apart by the texts
        for seen in filters(several):
            told = chunk_rows(docs, seen, hash_bits).join(several, ["h1", "h2"])
            keepers = told.groupBy("h1", "h2", "chunk").agg(F.min(place).alias("keeper"))
            earlier = earlier.unionByName(told.join(keepers, ["h1", "h2", "chunk"]).select(earlier.columns))
    earlier = earlier.where(~F.col("keeper").eqNullSafe(place))
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("pos")))
    return earlier.groupBy("doc_id", "rid").agg(of(CHUNK).alias("gone"), of(PAIR).alias("gone_pairs"))


def repeated_stretches(lines: list[str], gone_pairs: list[int]) -> list[tuple[int, int]]:
    """(first line, line after the last) of the stretches of ``LONG_WORDS`` words of neighbouring pairs that are gone."""
    gone, out, start, end = set(gone_pairs), [], -1, -1
    for a, b in [*line_pairs(lines), (len(lines) + 1, -1)]:
        if a in gone:
            start, end = (start if start >= 0 else a), b
        elif start >= 0:
            if sum(len(line.split()) for line in lines[start:end]) >= LONG_WORDS:
                out.append((start, end))
            start = -1
    return out


def without_chunks(text: str, gone: list[int], gone_pairs: list[int] = ()) -> tuple[str, int, int]:
    """The text without the chunks that start at these lines, and without stretches of pairs that do; removed chunks, stretches counted where they hold other lines, and lines."""
    lines = text.split("\n")
    ends = dict(line_chunks(lines)) if gone else {}
    removed = {i for a in gone for i in range(a, ends[a])}
    stretches = [i for i in repeated_stretches(lines, gone_pairs) if not removed.issuperset(range(*i))] if gone_pairs else []
    removed.update(i for a, b in stretches for i in range(a, b))
    if not removed:
        return text, 0, 0
    return "\n".join([line for i, line in enumerate(lines) if i not in removed]), len(gone) + len(stretches), len(removed)


def dedup_lines(docs: DataFrame, hash_bits: int = 128) -> DataFrame:
    """All columns of docs with the cleaned text, and n_chunks_removed and n_lines_removed."""
    rid = F.xxhash64("doc_id", "text")
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", rid)
    gone = removals(slim, hash_bits).select(F.col("doc_id").alias("__doc"), F.col("rid").alias("__rid"), F.col("gone").alias("__gone"), F.col("gone_pairs").alias("__pairs"))
    own = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    own = own.withColumn("__own", F.xxhash64("doc_id", "__text"))
    joined = own.join(gone, (F.col("__own") == F.col("__rid")) & own["doc_id"].eqNullSafe(F.col("__doc")), "left")
    names = [c for c in docs.columns if c not in ("text", "n_chunks_removed", "n_lines_removed")]
    at_text = len(names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = zip(*(batch.column(at_text + i).to_pylist() for i in range(3)))
            out = [without_chunks(t, g or [], p or []) if g or p else (t, 0, 0) for t, g, p in rows]
            new, chunks, lines = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(at_text)], pa.array(new, pa.string()), pa.array(chunks, pa.int64()), pa.array(lines, pa.int64())],
                [*names, "text", "n_chunks_removed", "n_lines_removed"],
            )

    cleaned = joined.select(*[own[c] for c in names], "__text", "__gone", "__pairs").mapInArrow(run, f"{fields}, text string, n_chunks_removed bigint, n_lines_removed bigint")
    return cleaned.select(*docs.columns, *[c for c in ("n_chunks_removed", "n_lines_removed") if c not in docs.columns])
