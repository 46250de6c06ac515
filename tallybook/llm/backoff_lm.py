"""Operator 12: language-model scores by a weighted backoff automaton over n-grams of the corpus.

The model learns n-grams up to ``order`` words from all training documents; nothing is left out, so
it grows with them. Probabilities are smoothed from the shorter history upwards: with c the counts in training,

    p(w | h) = (c(h w) + PRIOR * p(w | h')) / (c(h) + PRIOR),    p(w) = (c(w) + 1) / (N + V + 1),

h' being h without its first word. As an automaton: a history that training has is a state, a word that training has after it an arc with
the weight log10 p, and every state has a failure arc to its shorter history with the weight log10(PRIOR / (c(h) + PRIOR)).
A traversal from left to right starts each document in the state of its beginning, follows failure arcs until one has the word, adds up the weights and
goes on in the longest state that the words so far lead to. Each history's probabilities, unknown words included, sum to one.

The corpus's automaton fits into no task, but the part that a block of documents walks does. So the documents are cut into blocks of a
bounded number of tokens; each block lists its distinct n-grams, with their counts in its training documents, by ranges of their hashes; each
range adds up what all blocks have counted and answers every block with the corpus's counts, in the order asked; with these a block builds its
part of the automaton and walks it. Frequent n-grams are counted within the blocks first, and ranges of hashes are even,
so no word or pair makes a task large. Words are known by 128-bit hashes, longer n-grams by 64 bits: with 10^12 of them, some one
in 40 million shares its count with another.

Tokens are words, and one end of each document. Null texts count as empty: the end alone. Null keys count as the empty text in the hash that decides
about training. Repeated rows count, and are scored, as often as they stand. Without training documents every probability is 1. An empty table gives an empty
result. Long texts are read in pieces that may lie in several blocks, each with the words before it as its history. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, READ_ROWS, gathered, setting, slices, stored, texts

ORDER = 2
#: Tokens that a history must have before it outweighs the shorter one; on the held-out documents of the given tables 50 gives 0.34 more (in log10, a token) than 2.
PRIOR = 50.0
#: Documents whose key's crc32 leaves this remainder are held out.
FOLDS, HELD_OUT = 7, 2
#: Tokens of a block, at most one piece more, and bytes of a piece of a text, at most one word more.
BLOCK_TOKENS, PIECE = 1_000_000, 1 << 20
#: Rows are blocks here, so a batch of rows between Spark and Python is kept to few of them.
BATCH = "4m"
#: Parquet otherwise looks at the size of its pages and row groups after 100 rows only: these may be hundreds of MB then, which a task holds several times to write or read them.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}
READ = 64
#: Bytes of text whose n-grams share a range of hashes on average, and of counts in a batch of answers.
RANGE_BYTES, ANSWER_BYTES = 16 << 20, 1 << 20
#: Bytes of text that a task has on average, once there is more than that for each core.
TASK_BYTES = 64 << 20
SPACE = re.compile(rb"[\x09-\x0D\x20]")
#: Stand for the beginning and the end; no word has a space in it.
BEGIN, END = b" <", b" >"
ODD = np.uint64(0x9E3779B97F4A7C15)


class Ids(dict):
    """Word -> its number in a block; fills itself."""

    def __missing__(self, word: bytes) -> int:
        own = self[word] = len(self)
        return own


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def word_lists(text: str, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text with A-Z in lower case, some at a time; at least one list, which may be empty."""
    data, at = text.encode().lower(), 0
    while True:
        m = SPACE.search(data, at + piece)
        end = m.end() if m else len(data)
        yield data[at:end].split()
        at = end
        if at >= len(data):
            return


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of 0 or more byte by byte, without the upper bytes that are zero in all of them; first how many bytes each has."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8)
    return bytes([width]) + numbers.view(np.uint8).reshape(len(numbers), -1)[:, :width].T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    lower = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros(lower.shape[1], kind)
    out.view(np.uint8).reshape(len(out), -1)[:, : len(lower)] = lower.T
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """The differences of ascending keys, the first one from 0."""
    out = keys.copy()
    out[1:] -= keys[:-1]
    return out


BLOCK = "block bigint, ids binary, words binary, keys array<{kind}>, numbers array<bigint>, lengths array<bigint>, contexts array<bigint>, trains array<boolean>"


def token_blocks(docs: DataFrame, key: str, order: int, block_tokens: int = BLOCK_TOKENS, piece: int = PIECE) -> DataFrame:
    """Blocks of whole tokens: the numbers of their words, the words' hashes, and for each piece of a document its key, number, length, words of history before it, and whether it is for training.

    Blocks and documents are numbered by the task's partition, so a result that is not stored yet must not be coalesced: its tasks would give a number more than once. ``docs`` may be.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("words", pa.binary()), ("keys", pa.list_(key_type)), ("numbers", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("contexts", pa.list_(pa.int64())), ("trains", pa.list_(pa.bool_()))])
        first = TaskContext.get().partitionId() << 40
        blocks, doc, tokens = 0, 0, 0
        ids, stream, pieces = Ids(), [], []

        def block() -> pa.RecordBatch:
            hashes = b"".join(xxhash.xxh3_128_digest(w) for w in ids)
            own = zlib.compress(packed(np.concatenate(stream)), 1)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([first + blocks, own, hashes, *map(list, zip(*pieces))], schema)], schema=schema)

        for batch in slices(batches):
            for own_key, text, train in zip(batch.column(0).to_pylist(), texts(batch), batch.column(2).to_pylist()):
                history, lists = [BEGIN], word_lists(text, piece)
                words = next(lists)
                while words is not None:
                    ahead = next(lists, None)
                    if ahead is None:
                        words.append(END)
                    own = np.fromiter(map(ids.__getitem__, history + words), np.int32, len(history) + len(words))
                    stream.append(own)
                    pieces.append((own_key, first + doc, len(own), len(history), train))
                    tokens += len(own)
                    history = [*history, *words][-max(1, order - 1) :]
                    words = ahead
                    if tokens >= block_tokens:
                        yield block()
                        blocks, tokens, ids, stream, pieces = blocks + 1, 0, Ids(), [], []
                doc += 1
        if pieces:
            yield block()

    key_type = pa.array([], type=_arrow(kind)).type
    return docs.select(docs[key].alias("key"), docs["text"].alias("text"), (~held_out(docs[key])).alias("train")).mapInArrow(run, BLOCK.format(kind=kind))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[kind]


class Grams(NamedTuple):
    """The distinct n-grams of one order in a block, in order of their hashes."""

    keys: np.ndarray
    #: Where each first ends in the block's tokens, and which one ends at each token (-1: none does within its piece).
    first: np.ndarray
    at: np.ndarray


class Block:
    """The tokens of a block and its n-grams."""

    def __init__(self, row: dict, order: int):
        self.ids = unpacked(zlib.decompress(row["ids"]), np.int32)
        self.lengths = np.array(row["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        offset = np.arange(len(self.ids), dtype=np.int32)
        offset -= np.repeat(self.starts.astype(np.int32), self.lengths)
        self.scored = offset >= np.repeat(np.array(row["contexts"], np.int32), self.lengths)
        self.train = np.repeat(np.array(row["trains"], bool), self.lengths)
        #: Tokens that are counted: the scored ones, and as a history the beginning of each document.
        self.begins = self.ids == begin_id(row)
        words = np.frombuffer(row["words"], ">u8").astype(np.uint64).reshape(-1, 2)
        rank = np.lexsort((words[:, 1], words[:, 0]))
        place = np.empty(len(rank), np.int32)
        place[rank] = np.arange(len(rank), dtype=np.int32)
        at = place[self.ids]
        first = np.zeros(len(rank), np.int32)
        first[at[::-1]] = np.arange(len(at), dtype=np.int32)[::-1]
        self.words = words[rank]
        self.grams = [Grams(self.words[:, 0], first, at)]
        own = words[:, 1][self.ids]
        key = own
        for k in range(2, order + 1):
            longer = np.zeros_like(key)
            longer[1:] = key[:-1] * ODD + own[1:]
            longer ^= longer >> np.uint64(29)
            longer *= np.uint64(0xBF58476D1CE4E5B9)
            longer ^= longer >> np.uint64(32)
            key = longer
            some = np.flatnonzero(offset >= k - 1).astype(np.int32)
            keys, index, inverse = np.unique(key[some], return_index=True, return_inverse=True)
            at = np.full(len(key), -1, np.int32)
            at[some] = inverse
            self.grams.append(Grams(keys, some[index], at))
            del inverse, index, some

    def counts(self) -> list[np.ndarray]:
        """How often each n-gram ends at a token of a training document."""
        own = self.train & self.scored
        out = [np.bincount(g.at[own & (g.at >= 0)], minlength=len(g.keys)) for g in self.grams]
        out[0] += np.bincount(self.grams[0].at[self.train & self.begins], minlength=len(out[0]))
        return out


def begin_id(row: dict) -> int:
    """The number of the beginning in a block, -1 if no document begins in it."""
    own, hashes = xxhash.xxh3_128_digest(BEGIN), row["words"]
    at = hashes.find(own)
    while at > 0 and at % 16:
        at = hashes.find(own, at + 1)
    return at // 16 if at >= 0 else -1


def range_ends(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` even ranges of hashes ends among ascending keys."""
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


ASKED = "part int, block bigint, n int, low binary, keys binary, counts binary"


def asked(blocks: DataFrame, order: int, ranges: int) -> DataFrame:
    """What each block asks of each range of hashes: its n-grams of each order (n) there with their counts, and for words the other half of the hash."""
    names = ["part", "block", "n", "low", "keys", "counts"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            block = Block(row, order)
            for k, (grams, counts) in enumerate(zip(block.grams, block.counts()), 1):
                rows, start = [], 0
                for part, end in enumerate(range_ends(grams.keys, ranges).tolist()):
                    if end > start:
                        low = packed(block.words[start:end, 1].copy()) if k == 1 else None
                        rows.append((part, row["block"], k, low, packed(steps(grams.keys[start:end])), packed(counts[start:end])))
                    start = end
                if rows:  # a block of short texts may have no n-gram of this order
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return blocks.select("block", "ids", "words", "lengths", "contexts", "trains").mapInArrow(run, ASKED)


def answers(requests: DataFrame, tasks: int) -> DataFrame:
    """For each block, order (n) and range (part) the counts of its n-grams in all blocks; on rows without a block how many words training has (types, tokens)."""
    begin = np.frombuffer(xxhash.xxh3_128_digest(BEGIN), ">u8").astype(np.uint64)
    schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64())])

    def summed(part: int, n: int, rows: list[tuple[int, bytes | None, bytes, bytes]]) -> Iterator[tuple]:
        """``rows``, of one order, is emptied."""
        own = [r[0] for r in rows]
        low = np.concatenate([unpacked(r[1], np.uint64) for r in rows]) if n == 1 else None
        keys = [np.cumsum(unpacked(r[2], np.uint64), dtype=np.uint64) for r in rows]
        ends = np.cumsum([len(x) for x in keys])
        keys = np.concatenate(keys)
        counts = np.concatenate([unpacked(r[3], np.int64) for r in rows])
        rows.clear()
        ranked = np.argsort(keys) if low is None else np.lexsort((low, keys))
        keys = keys[ranked]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        if low is not None:
            low = low[ranked]
            fresh[1:] |= low[1:] != low[:-1]
        firsts = np.flatnonzero(fresh)
        total = np.add.reduceat(counts[ranked], firsts)
        if low is not None:
            words = np.where((keys[firsts] == begin[0]) & (low[firsts] == begin[1]), 0, total)
            yield None, n, part, None, int(np.count_nonzero(words)), int(words.sum())
        counts[ranked] = np.repeat(total, np.diff(firsts, append=len(keys)))
        for block, piece in zip(own, np.split(counts, ends[:-1])):
            yield block, n, part, packed(piece), None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_order: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                by_order.setdefault(row["n"], []).append((row["block"], row["low"], row["keys"], row["counts"]))
        out, size = [], 0
        for row in (row for n in sorted(by_order) for row in summed(part, n, by_order[n])):
            out.append(row)
            size += len(row[3] or b"")
            if size >= ANSWER_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return requests.repartition(tasks, "part").groupBy("part").applyInArrow(run, "block bigint, n int, part int, counts binary, types bigint, tokens bigint")


class Automaton:
    """The part of the automaton that a block walks. For each order: log10 weights of the arcs, whether training has them, and as states their failure weights."""

    def __init__(self, block: Block, counts: list[np.ndarray], tokens: int, types: int, prior: float):
        likely = (counts[0] + 1) / (tokens + types + 1)
        self.base = np.log10(likely)
        self.weights, self.seen, self.falls = [self.base], [counts[0] > 0], []
        for k in range(1, len(counts)):
            shorter, own = block.grams[k - 1], block.grams[k]
            history = counts[k - 1][shorter.at[own.first - 1]]
            likely = (counts[k] + prior * likely[shorter.at[own.first]]) / (history + prior)
            self.falls.append(np.log10(prior / (counts[k - 1] + prior)))
            self.weights.append(np.log10(likely))
            self.seen.append(counts[k] > 0)

    def walk(self, block: Block) -> np.ndarray:
        """The weight of the path from each token to the next: from the longest state that its history leads to, failure arcs until one has an arc of the word, and that."""
        out, open_ = np.zeros(len(block.ids)), block.scored.copy()
        for k in range(len(self.weights) - 1, 0, -1):
            here = np.flatnonzero(open_ & (block.grams[k].at >= 0))
            state = block.grams[k - 1].at[here - 1]
            known = self.seen[k - 1][state]  # otherwise the history is no state, and the walk stands in a shorter one already
            here, state = here[known], state[known]
            arc = block.grams[k].at[here]
            has = self.seen[k][arc]
            out[here[has]] += self.weights[k][arc[has]]
            open_[here[has]] = False
            out[here[~has]] += self.falls[k - 1][state[~has]]
        rest = np.flatnonzero(open_)
        out[rest] += self.base[block.grams[0].at[rest]]
        return out


def score(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, key: str = "doc_id", block_tokens: int = BLOCK_TOKENS, piece: int = PIECE) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every document: log10 probabilities by words alone and by the automaton.

    ``block_tokens`` and ``piece`` (bytes of a text) bound the memory of a task, whatever the texts' lengths, and change no score.
    """
    with setting(docs.sparkSession, BATCH_BYTES, BATCH), setting(docs.sparkSession, READ_ROWS, str(READ)):
        return _score(docs, order, prior, key, block_tokens, piece)


def _score(docs: DataFrame, order: int, prior: float, key: str, block_tokens: int, piece: int) -> DataFrame:
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))
    # few files, a task for each core or more: an executor's JVM starts a process for each file it writes
    each = max(1, math.ceil(size / TASK_BYTES / spark.sparkContext.defaultParallelism))
    # as many shuffle partitions: where a task had several, one after the other, executors were seen to take some 500 MB more
    tasks = each * spark.sparkContext.defaultParallelism
    blocks = stored(token_blocks(gathered(docs.select(docs[key], docs["text"]), each), key, order, block_tokens, piece), **LARGE_ROWS)
    found = stored(gathered(answers(asked(blocks, order, ranges), tasks), each), **LARGE_ROWS)
    types, tokens = found.where("block is null").agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    names = ["number", "key", "n_tokens", "n_known", "base_score", "score"]
    key_type = _arrow(kind)

    def run(mine: pa.Table, told: pa.Table) -> pa.Table:
        row = mine.to_pylist()[0]
        block = Block(row, order)
        replies = sorted(zip(told.column("n").to_pylist(), told.column("part").to_pylist(), told.column("counts").to_pylist()), key=lambda r: r[:2])
        counts = [np.concatenate([unpacked(c, np.int64) for n, _, c in replies if n == k]) if len(g.keys) else np.zeros(0, np.int64) for k, g in enumerate(block.grams, 1)]
        automaton = Automaton(block, counts, tokens, types, prior)
        walked = automaton.walk(block)
        base = automaton.base[block.grams[0].at]
        known = automaton.seen[0][block.grams[0].at] & block.scored
        ends, out = np.cumsum(block.lengths), []
        for k, number, a, b, c in zip(row["keys"], row["numbers"], block.starts.tolist(), ends.tolist(), row["contexts"]):
            out.append((number, k, b - a - c, int(np.count_nonzero(known[a:b])), math.fsum(base[a + c : b].tolist()), math.fsum(walked[a + c : b].tolist())))
        kinds = [pa.int64(), key_type, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

    told = found.where("block is not null").select("block", "n", "part", "counts")
    pieces = stored(gathered(blocks.repartition(tasks, "block").groupBy("block").cogroup(told.repartition(tasks, "block").groupBy("block")).applyInArrow(run, f"number bigint, key {kind}, n_tokens bigint, n_known bigint, base_score double, score double"), each))
    whole = gathered(pieces.groupBy("number").agg(F.first("key").alias(key), *[F.sum(c).alias(c) for c in names[2:]]), each)
    return whole.select(key, held_out(F.col(key)).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
