"""Operator 5: SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

The automaton holds all pieces of the vocabulary. It reads a text once; at each position its output
links list the pieces that end there, and each relaxes the best score of that position from the one
at its start. Following the best pieces back from the end gives the segmentation with the greatest sum
of piece scores; at equal sums the longer last piece wins. For vocabularies of the merging kind
(``merges=True``) a piece may relax a position only if the merges of its joint text with the piece
before it give these two back: one path is left then, the one that the merges themselves take.
Characters that no piece covers cost 10 less than the least score and become byte pieces where the
vocabulary has them. No piece of the vocabulary goes on past a space that follows another character,
so the best segmentation of a text is made of those of its words, which are remembered.

The scores are those of the vocabulary file. Encoding escapes spaces and puts one before the text; so
decoding gives the text back, except that U+2581 in a text comes back as a space. Null and empty texts
give no pieces. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, texts

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
NEVER = float("-inf")
REMEMBERED = 1_000_000
#: Pairs of neighbouring pieces whose merging is remembered.
REMEMBERED_PAIRS = 300_000
#: Characters before which a text is cut where no piece spans the place.
STOPS = ".,;:!?"


class PieceModel(dict):
    """Escaped chunk of text -> ids as int32 bytes; fills itself."""

    def __init__(self, path: str, merges: bool = True, remembered: int = REMEMBERED):
        super().__init__()
        self.remembered = remembered
        self.merges = merges
        self.pairs: dict[int, bool] = {}
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.bytes_of = [b""] * n
        self.byte_ids = [-1] * 256
        self.unknown = lib.unk_id()
        self.automaton = ahocorasick.Automaton()
        normal = []
        for i, piece in enumerate(self.pieces):
            if lib.is_byte(i):
                self.byte_ids[b := int(piece[3:-1], 16)] = i
                self.bytes_of[i] = bytes([b])
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                normal.append((piece, i, lib.get_score(i)))
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.bytes_of[self.unknown] = " ⁇ ".encode()
        for piece, i, score in normal:
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.score = {piece: score for piece, _, score in normal}
        self.least = min(score for *_, score in normal) - UNKNOWN_PENALTY
        spanned = {pair for piece, *_ in normal for pair in zip(piece, piece[1:])}
        apart = [c for c in "\n\t" if c not in self.score]  # in no piece at all
        apart = "".join(c for c in apart if not any(c in pair for pair in spanned))
        whole = any(a != SPACE and b == SPACE for a, b in spanned)
        rest = "".join(apart)
        cuts = [f"(?<![{re.escape(''.join(sorted({a for a, b in spanned if b == c})) + c)}])(?={re.escape(c)})" for c in STOPS]
        word = f"{SPACE}*(?:[^{SPACE}{rest}](?:(?!{'|'.join(cuts)})[^{SPACE}{rest}])*)|{SPACE}+"
        coarse = f"{SPACE}*[^{SPACE}{rest}]+|{SPACE}+"
        self.chunks = re.compile(f"[{rest}]|{coarse}" if rest else coarse) if not whole else None
        self.parts = re.compile(f"[{rest}]|{word}" if rest else word) if not whole else None

    def merged(self, text: str) -> list[str]:
        """Merges the neighbours whose joint piece has the best score, the left ones first, until none is left. For short inputs."""
        symbols = list(text)
        while len(symbols) > 1:
            scores = [self.score.get(a + b, float("-inf")) for a, b in zip(symbols, symbols[1:])]
            best = max(range(len(scores)), key=scores.__getitem__)
            if scores[best] == float("-inf"):
                break
            symbols = [*symbols[:best], symbols[best] + symbols[best + 1], *symbols[best + 2 :]]
        return symbols

    def allowed(self, before: int, piece: int) -> bool:
        """before: -1 at the start of a chunk or after a character that no piece covers."""
        both = [self.pieces[piece]] if before < 0 else [self.pieces[before], self.pieces[piece]]
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        known = self.pairs[(before << 32) + piece] = self.merged("".join(both)) == both
        return known

    def viterbi(self, chunk: str) -> list[int]:
        n = len(chunk)
        best, length, last = [0.0] + [NEVER] * n, [0] * (n + 1), [-1] * (n + 1)
        known, merges, done = self.pairs.get, self.merges, 0
        for end, (m, piece, score) in self.automaton.iter(chunk):
            end += 1
            while done < end - 1:  # characters that no piece reaches
                done += 1
                if best[done] == NEVER:
                    best[done], length[done] = best[done - 1] + self.least, 1
            s = best[end - m] + score
            if s > best[end] or s == best[end] > NEVER and m > length[end]:
                if merges:
                    before = last[end - m]
                    fits = known((before << 32) + piece)
                    if not (self.allowed(before, piece) if fits is None else fits):
                        continue
                best[end], length[end], last[end] = s, m, piece
        for done in range(done + 1, n + 1):
            if best[done] == NEVER:
                best[done], length[done] = best[done - 1] + self.least, 1
        out: list[int] = []
        at = n
        while at:
            if last[at] < 0:
                fallback = [self.byte_ids[b] for b in chunk[at - 1].encode()]
                out.extend(reversed(fallback) if min(fallback) >= 0 else [self.unknown])
            else:
                out.append(last[at])
            at -= length[at]
        return out[::-1]

    def __missing__(self, chunk: str) -> bytes:
        parts = self.parts.findall(chunk) if self.parts else [chunk]
        ids = b"".join(map(self.__getitem__, parts)) if len(parts) > 1 else np.array(self.viterbi(chunk), np.int32).tobytes()
        if len(chunk) < 200:
            if len(self) >= self.remembered:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        escaped = SPACE + text.replace(" ", SPACE)
        chunks = self.chunks.findall(escaped) if self.chunks else [escaped]
        return np.frombuffer(b"".join(map(self.__getitem__, chunks)), np.int32)

    def decode(self, ids) -> str:
        own = self.bytes_of
        out = b"".join([own[i] for i in ids]).decode(errors="replace")
        return out[1:] if out.startswith(" ") else out


@lru_cache(maxsize=2)
def model(path: str, remembered: int = REMEMBERED) -> PieceModel:
    """The vocabulary at ``path``, which is of the merging kind."""
    return PieceModel(path, remembered=remembered)


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), remembered: int = REMEMBERED) -> DataFrame:
    """The ``keep`` columns, ids and n_pieces of every text. Workers remember up to ``remembered`` words."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = model(vocabulary, remembered)
        ids = [own.encode(t) for t in texts(batch, "__text")]
        counts = np.array([len(x) for x in ids], np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        values = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32())
        return pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in range(len(keep))], pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(counts)], [*keep, "ids", "n_pieces"]
        )

    return map_rows(docs.select(*keep, docs[text].alias("__text")), run, f"{fields}, ids array<int>, n_pieces bigint")


def decode_documents(encoded: DataFrame, vocabulary: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and the text of every list of ids; null is decoded as an empty list."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = model(vocabulary)
        out = [own.decode(x or []) for x in batch.column(len(keep)).to_pylist()]
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(out, pa.string())], [*keep, "text"])

    return map_rows(encoded.select(*keep, encoded[ids].alias("__ids")), run, f"{fields}, text string")


def piece_digests(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, n_pieces, ids_sha256 (of the ids as little-endian int32), and whether decoding gives the text back."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = model(vocabulary)
        counts, digests, same = [], [], []
        for t in texts(batch, "__text"):
            ids = own.encode(t)
            counts.append(len(ids))
            digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
            same.append(own.decode(ids.tolist()) == t.replace(SPACE, " "))
        return pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in range(len(keep))], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())],
            [*keep, "n_pieces", "ids_sha256", "round_trip"],
        )

    return map_rows(docs.select(*keep, docs[text].alias("__text")), run, f"{fields}, n_pieces bigint, ids_sha256 string, round_trip boolean")
