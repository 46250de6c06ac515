"""Operator 13: fill-in-middle transformation by content-defined chunk memoization.

A text is cut into units (lines) and a prefix, a middle and a suffix of whole units are put in another
order, with marks between them. Where the cuts lie is found over content-defined chunks: a rolling hash
over the bytes sets their ends, so texts that share passages share chunks. A chunk is read once and its
summary remembered under its content: how many characters and line ends it has, and whether a
mark stands in it. Adding up the chunks' counts gives the number of units of a text and the chunk a cut
lies in; only that one is looked at again. Marks that lie across an end of chunks are found in the few bytes
on both sides of it. A remembered summary is taken only for the same bytes; what is remembered is
bounded and started afresh when it is full.

Which form a text takes and where it is cut follows from a hash of its key, so reruns agree. Null texts
count as empty; a null key counts as the empty text. Empty texts, texts with a mark in them and a share of the
others stay plain. Repeated rows give repeated results; an empty table gives none. A text of one unit has cuts at its ends
only. Columns other than the key and the text are ignored, whatever they are called. A text is
cut whatever its length; besides the text itself the work needs its chunks' counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "7"
#: Hundredths of the texts that are changed, and of these the ones with the suffix first.
CHANGED, SUFFIX_FIRST = 100, 50
#: A chunk ends where the rolling hash is below ENDS, so where its highest bits, which all bytes it covers have a part in, are zero: every 1,024 bytes on average, after LONGEST at the latest.
ENDS, LONGEST = np.uint32(1 << 22), 1 << 14
#: Bytes of chunks that a Python worker remembers.
REMEMBERED = 48 << 20
#: Bytes whose hashes are computed at once.
BLOCK = 1 << 20
GEAR = np.random.default_rng(13).integers(0, 1 << 32, 256, dtype=np.uint32)
#: A hash covers as many bytes as it has bits: older ones are shifted out.
REACH = 32
MARK = re.compile(b"<[PSM]>")
#: Bytes on each side of an end of chunks within which a mark can lie across it.
SIDE = 2


class Summary(NamedTuple):
    characters: int
    line_ends: int
    marked: bool


def chunk_ends(data: bytes) -> list[int]:
    """The ends of the content-defined chunks, never within a character."""
    ends: list[int] = []
    for start in range(0, len(data), BLOCK):
        low = max(0, start - REACH + 1)
        b = np.frombuffer(data, np.uint8, min(BLOCK + start, len(data)) - low, low)
        h, width = GEAR[b], 1
        while width < REACH:  # the sum over twice as many bytes from the sums over these and the ones before them
            h[width:] += h[:-width] << np.uint32(width)
            width *= 2
        ends += (np.flatnonzero(h[start - low :] < ENDS) + start + 1).tolist()
    out, last = [], 0
    for end in [*ends, len(data)]:
        while end - last > LONGEST or end == len(data) != last:
            cut = min(end, last + LONGEST)
            while cut < len(data) and data[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(cut)
            last = cut
        if end > last and data[end] & 0xC0 != 0x80:
            out.append(end)
            last = end
    return out


class Chunks(dict):
    """Chunk -> summary; fills itself."""

    held = 0

    def __missing__(self, chunk: bytes) -> Summary:
        if self.held > REMEMBERED:
            self.clear()
            self.held = 0
        b = np.frombuffer(chunk, np.uint8)
        own = self[chunk] = Summary(int(np.count_nonzero(b & 0xC0 != 0x80)), chunk.count(b"\n"), MARK.search(chunk) is not None)
        self.held += len(chunk) + 200
        return own


class Units:
    """The lines of a text by the summaries of its chunks."""

    def __init__(self, data: bytes, known: Chunks):
        self.data = data
        ends = chunk_ends(data)
        self.starts = [0, *ends[:-1]]
        self.summaries = [known[data[a:b]] for a, b in zip(self.starts, ends)]
        self.line_ends = np.cumsum([s.line_ends for s in self.summaries], dtype=np.int64)
        self.characters = np.cumsum([0, *[s.characters for s in self.summaries]], dtype=np.int64)
        total = int(self.line_ends[-1]) if ends else 0
        self.number = total + bool(data and not data.endswith(b"\n"))

    def marked(self) -> bool:
        return any(s.marked for s in self.summaries) or any(MARK.search(self.data, max(0, a - SIDE), a + SIDE) for a in self.starts[1:])

    def place(self, units: int) -> tuple[int, int]:
        """(bytes, characters) of the first ``units`` units."""
        if not units:
            return 0, 0
        if units > (self.line_ends[-1] if len(self.line_ends) else 0):
            return len(self.data), int(self.characters[-1])
        i = int(np.searchsorted(self.line_ends, units))
        at, start = self.starts[i], self.starts[i]
        for _ in range(units - (int(self.line_ends[i - 1]) if i else 0)):
            at = self.data.index(b"\n", at) + 1
        inside = np.frombuffer(self.data, np.uint8, at - start, start)
        return at, int(self.characters[i]) + int(np.count_nonzero(inside & 0xC0 != 0x80))


def hashes(key: Column, seed: str = SEED) -> list[Column]:
    """The first four groups of 32 bits of sha256 of ``<seed>:<key>``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"__h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """key, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output of every text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marks = Chunks(), [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
        for batch in slices(batches):
            rows = []
            for value, h1, h2, h3, h4 in zip(texts(batch), *(batch.column(f"__h{i}").to_pylist() for i in (1, 2, 3, 4))):
                data = value.encode()
                units = Units(data, known)
                n = units.number
                if not n or h3 % 100 >= changed or units.marked():
                    rows.append((n, "plain", None, None, value))
                    continue
                first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                (a, a_chars), (b, b_chars) = units.place(first), units.place(second)
                pre, mid, suf = data[:a], data[a:b], data[b:]
                p, s, m = marks
                out = b"".join((s, suf, p, pre, m, mid) if h4 % 100 < suffix_first else (p, pre, s, suf, m, mid))
                rows.append((n, "spm" if h4 % 100 < suffix_first else "psm", a_chars, b_chars - a_chars, out.decode()))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds)]], [key, "n", "form", "prefix_chars", "middle_chars", "output"])

    own = docs.select(docs[key], docs[text].alias("text"), *hashes(docs[key], seed))
    return own.mapInArrow(run, f"`{key}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form."""
    behind = lambda c, mark: F.substring_index(c, mark, -1)
    ahead = lambda c, mark: F.substring_index(c, mark, 1)
    middle, rest = behind(output, MIDDLE), ahead(output, MIDDLE)
    psm = F.concat(behind(ahead(rest, SUFFIX), PREFIX), middle, behind(rest, SUFFIX))
    spm = F.concat(behind(rest, PREFIX), middle, behind(ahead(rest, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fim_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    own = fill_in_middle(docs)
    return own.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
