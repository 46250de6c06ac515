"""Operator 2: token counts by prefix dynamic programming.

A byte-pair encoding is valid exactly when each pair of neighbouring tokens is one that encoding their
joint text gives back. So the last token of the encoding of every prefix follows from the shorter
prefixes: it is the one token that ends there and goes with the last token of what stands before it.
The count of a prefix is one more than that of the prefix before its last token. Words, which never
merge with each other, are counted this way once each and remembered; sums over the words give the
count at each word's end, and the rows inside the words give every other prefix. Truncation and budget
questions are then look-ups.

The rows of a word serve every prefix of the text that ends in it, as long as its characters are normalized one by one.
Where they are not (letters with combining marks of their own, a capital sigma, conjoining jamo), the prefixes that
end between two places where the text can be cut without effect are split anew; that is one word or a few characters.

Null texts count as empty: 0 bytes, 0 tokens. The names of special tokens inside a text count as one
token each, as the vocabulary's own library has it by default. Repeated rows give repeated results and
columns other than the key columns and the text are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, texts

#: Words and pairs of tokens remembered by a Python worker; when there are more, it starts afresh. Longer words are not remembered.
REMEMBERED, LONGEST_REMEMBERED = 1_200_000, 64
SIMPLE = 0x250
SIGMA = "\u03a3"
#: An apostrophe may begin a contraction; the small form of the dotted I ends with a mark.
NO_CUT_AFTER = "'\u0130"
#: Different parts of a text whose rows are kept while it is read.
BLOCK_PARTS = 50_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in own else chr(spare)
        spare += b not in own
    return out


class PrefixCounter(dict):
    """Word -> number of tokens; fills itself. ``vocabulary`` is the path of a tokenizer's JSON file."""

    def __init__(self, vocabulary: str):
        super().__init__()
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.vocabulary = frozenset(model["vocab"])
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocabulary)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.letters = byte_letters()
        specials = [t["content"] for t in spec["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))) or r"(?!)")
        self.library = None
        self.path = vocabulary
        low = [chr(i) for i in range(SIMPLE)]
        group = lambda kind: "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == kind)
        spaces = "\t\n\x0b\x0c\r \x85\xa0"
        letters, numbers = group("L"), group("N")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")
        self.complex = re.compile(f"[^\x00-{chr(SIMPLE - 1)}]")

    def symbols(self, token: str) -> list[str]:
        stem = token.removesuffix(self.end)
        out = list(stem)
        if stem != token:
            out[-1] += self.end
        return out

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair encoding, for short inputs."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols = [*symbols[:best], symbols[best] + symbols[best + 1], *symbols[best + 2 :]]
        return symbols

    def goes_with(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        return self.remember(a, b) if known is None else known

    def stands(self, a: str) -> bool:
        known = self.pairs.get(("", a))
        return self.remember("", a) if known is None else known

    def remember(self, a: str, b: str) -> bool:
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        known = self.pairs[a, b] = self.merged((self.symbols(a) if a else []) + self.symbols(b)) == ([a, b] if a else [b])
        return known

    def prefixes(self, word: str, all_ends: bool = False) -> tuple[list[int], list[int]]:
        """Token counts of each prefix of the word (in bytes), inside it and as a word of its own; of the latter only the last unless ``all_ends``."""
        w = "".join([self.letters[b] for b in word.encode()])
        n, vocabulary, end = len(w), self.vocabulary, self.end
        last, inside, whole = [""] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            low = max(0, i - self.longest)
            if i < n:
                for j in range(low, i):
                    t = w[j:i]
                    if t in vocabulary and (self.goes_with(last[j], t) if j else self.stands(t)):
                        last[i], inside[i] = t, inside[j] + 1
                        break
            if i == n or all_ends:
                for j in range(low, i):
                    t = w[j:i] + end
                    if t in vocabulary and (self.goes_with(last[j], t) if j else self.stands(t)):
                        whole[i] = inside[j] + 1
                        break
        return inside, whole

    def __missing__(self, word: str) -> int:
        n = self.prefixes(word)[1][-1]
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n

    def split(self, text: str) -> list[str]:
        """Normalized words of a text without special tokens."""
        lowered = text.lower()  # some letters below SIMPLE have small ones beyond it
        if not self.complex.search(lowered) and not self.complex.search(text):
            return self.words.findall(lowered)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.back = {c: b for b, c in enumerate(self.letters)}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([self.back[c] for c in piece]).decode() for piece, _ in pieces]

    def count(self, text: str) -> int:
        total, at = 0, 0
        for m in self.specials.finditer(text):
            total += sum(map(self.__getitem__, self.split(text[at : m.start()]))) + 1
            at = m.end()
        return total + sum(map(self.__getitem__, self.split(text[at:] if at else text)))

    def cuts(self, text: str) -> list[int]:
        """Places where the text can be cut, each side being normalized and split by itself, whatever stands behind the next one."""
        kinds = [kind_of(c) for c in text]
        out, sigma, joined, n = [0], False, False, len(text)
        for i, kind in enumerate(kinds):
            before = kinds[i - 1] if i else kind
            if kind == "M" != before:  # whether the marks change what they follow
                behind = i + 1
                while behind < n and kinds[behind] == "M":
                    behind += 1
                joined = i > 0 and composed(text[i - 1 : behind]) != composed(text[i - 1]) + composed(text[i:behind])
            if kind == " " or before == " ":
                sigma = False
                if i:
                    out.append(i)
            elif i and "N" in (kind, before) and kind != "M":
                sigma = False
                out.append(i)
            elif kind != before and not sigma and text[i - 1] not in NO_CUT_AFTER and not (joined and "M" in (kind, before)):
                # marks belong to the characters that are neither letters nor numbers
                if {kind, before} != {"M", "P"} and (kind == "M" or composed(text[i - 1 : i + 1]) == composed(text[i - 1]) + composed(text[i])):
                    out.append(i)
            sigma |= text[i] == SIGMA
        return [*out, n] if n else [0]

    def inner_counts(self, part: str) -> list[int]:
        """Tokens of part[:i] for i from 1 on; the part lies between two cuts."""
        single = [composed(c).lower() for c in part]
        whole = "".join(single)
        start = 0
        if part[0] == "'" and kind_of(part[1:2] or " ") == "L":
            start = len(self.split(part[:3])[0])
        if composed(part).lower() == whole and self.split(part[start:]) == ([whole[start:]] if start < len(part) else []):
            out = [sum(map(self.__getitem__, self.split(part[:i]))) for i in range(1, min(3, len(part)) + 1)] if start else []
            if len(part) > len(out):
                first, place = self[part[:start].lower()] if start else 0, 0
                rows = self.prefixes(whole[start:], all_ends=True)[1]
                for i, c in enumerate(single[start:], start + 1):
                    place += len(c.encode())
                    if i > len(out):
                        out.append(first + rows[place])
            return out
        return [sum(map(self.__getitem__, self.split(part[:i]))) for i in range(1, len(part) + 1)]

    def plain_prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:i] for each i, special names taken as they stand."""
        out, places = [0], self.cuts(text)
        known: dict[str, list[int]] = {}
        for a, b in zip(places, places[1:]):
            part, before = text[a:b], out[-1]
            if (rows := known.get(part)) is None:
                rows = self.inner_counts(part)
                if len(part) <= LONGEST_REMEMBERED and len(known) < BLOCK_PARTS:
                    known[part] = rows
            out.extend([before + n for n in rows])
        return out

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:i] for each i."""
        out, at = [0], 0
        for m in self.specials.finditer(text):
            before = out[-1]
            counts = self.plain_prefix_counts(text[at : m.end() - 1])
            out.extend([before + n for n in counts[1:]])
            out.append(before + counts[m.start() - at] + 1)
            at = m.end()
        before = out[-1]
        out.extend([before + n for n in self.plain_prefix_counts(text[at:])[1:]])
        return out

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix up to which no prefix has more than ``budget`` tokens."""
        return text[: bisect_right(running_most(self.prefix_counts(text)), budget) - 1]


def kind_of(c: str) -> str:
    """L, N, M (a mark), a space, or P for all else."""
    if c.isspace() and c not in "\x1c\x1d\x1e\x1f":
        return " "
    kind = unicodedata.category(c)[0]
    return kind if kind in "LNM" else "P"


def composed(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def running_most(counts: list[int]) -> list[int]:
    out, most = [], 0
    for n in counts:
        most = max(most, n)
        out.append(most)
    return out


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> PrefixCounter:
    return PrefixCounter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, values = counter(vocabulary), texts(batch, "__text")
        counts = [own.count(t) for t in values]
        columns = [batch.column(i) for i in range(len(keep))]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([len(t.encode()) for t in values], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
            [*keep, "n_bytes", "n_tokens", "over_limit"],
        )

    return map_rows(docs.select(*keep, docs[text].alias("__text")), run, f"{fields}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def truncate_to_budget(docs: DataFrame, vocabulary: str, budget: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and the longest prefix of every text that stays within ``budget`` tokens."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = counter(vocabulary)
        out = [own.truncate(t, budget) for t in texts(batch, "__text")]
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(out, pa.string())], [*keep, "truncated"])

    return map_rows(docs.select(*keep, docs[text].alias("__text")), run, f"{fields}, truncated string")
