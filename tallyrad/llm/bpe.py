"""Byte-pair encoding with exact merges in linear time, and decoding through an offset table.

The encoder walks a piece of text from left to right. An Aho-Corasick automaton over the vocabulary gives
the longest token at the positions it reaches. A token is taken if it may stand next to the one before it, that is
if merging both pieces by rank would have left this boundary alone; otherwise the next shorter token that
starts here is tried, and when none is left the walk steps back by one token. A bit for each position
remembers dead ends, so that no position is left twice and the work stays linear. The sequence found is
the only one whose neighbours are all compatible, which makes it the result of the merges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import byte_parts

#: Fixed value: the pattern by which byte-level vocabularies of this family split text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Whether white space stands at an end of a text, or next to other white space.
CROWDED = re.compile(r"^\s|\s\s|\s$").search

#: Pieces, and words with what clings to them, that a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 600_000

_loaded: dict[int, Codec] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """The printable stand-in for every byte that such vocabulary files use."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class Codec:
    """A vocabulary ready to encode and decode; built once for each worker from the file's content."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, back = spec["model"], byte_characters()
        raw = lambda token: bytes(back[c] for c in token)
        vocabulary = {raw(t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Tokens by rank: single bytes first, then merged ones in order of their merges.
        self.tokens = [bytes([b]) for b in range(256)]
        rank = {t: r for r, t in enumerate(self.tokens)}
        self.parts = [(r, r) for r in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair = (rank[raw(left)], rank[raw(right)])
            whole = raw(left) + raw(right)
            if whole not in rank:
                rank[whole] = len(self.tokens)
                self.tokens.append(whole)
                self.parts.append(pair)
            self.merged.setdefault(pair, rank[whole])
        self.id_bytes = [vocabulary[t].to_bytes(4, "little") for t in self.tokens]
        self.sizes = [len(t) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        #: The longest token that begins each path of the automaton from its root.
        self.longest: dict[str, int] = {}
        self.widest = max(map(len, self.tokens))
        for token in self.tokens:
            path = token.decode("latin-1")
            self.automaton.add_word(path, rank[token])
            for n in range(1, len(token) + 1):
                if (r := rank.get(token[:n])) is not None:
                    found = r
                self.longest[path[:n]] = found
        self.automaton.make_automaton()
        self.shorter = [self._longest_proper_prefix(t, rank) for t in self.tokens]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_split = (
            regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
            if self.special
            else None
        )
        self.split = regex.compile(SPLIT).findall
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.compatible: dict[int, bool] = {}
        self._offset_table(vocabulary)

    @staticmethod
    def _longest_proper_prefix(token: bytes, rank: dict[bytes, int]) -> int:
        for n in range(len(token) - 1, 0, -1):
            if token[:n] in rank:
                return rank[token[:n]]
        return -1

    def _offset_table(self, vocabulary: dict[bytes, int]) -> None:
        by_id = {i: t for t, i in vocabulary.items()} | {i: s.encode() for s, i in self.special.items()}
        size = max(by_id) + 1
        texts = [by_id.get(i, b"") for i in range(size)]
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves a boundary between these two tokens. Both are taken apart, newest
        merge first; the boundary fails if a pair across it would have been merged before those."""
        key = left << 32 | right
        if (known := self.compatible.get(key)) is not None:
            return known
        a, b, limit, answer = left, right, len(self.tokens), True
        while True:
            if self.merged.get((a, b), limit) < limit:
                answer = False
                break
            if a > b:
                limit = a
                a = self.parts[a][1]
                if a == limit:  # a single byte has no parts; go on with the other side
                    limit, b = b + 1, self.parts[b][0]
                    if b + 1 == limit:
                        break
            else:
                limit, was = b + 1, b
                b = self.parts[b][0]
                if b == was:
                    limit, was = a, a
                    a = self.parts[a][1]
                    if a == was:
                        break
        if len(self.compatible) > REMEMBERED:
            self.compatible.clear()
        self.compatible[key] = answer
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ranks of the tokens of one piece."""
        n = len(piece)
        if n == 1:
            return [piece[0]]
        characters, path, longest = piece.decode("latin-1"), self.automaton.longest_prefix, self.longest
        sizes, compatible, fits = self.sizes, self.compatible.get, self.fits
        # one pass of the automaton gives the longest token at every place that greedy steps reach; where steps go
        # elsewhere, the longest token is looked up from there
        greedy = {end + 1 - sizes[token]: token for end, token in self.automaton.iter_long(characters)}
        tokens, closed, at, token = [], set(), 0, greedy[0]
        while True:
            end = at + sizes[token]
            if tokens and (may := compatible(tokens[-1] << 32 | token)) is None:
                may = fits(tokens[-1], token)
            if end not in closed and (not tokens or may):
                tokens.append(token)
                if end == n:
                    return tokens
                at = end
                if (token := greedy.get(at)) is None:
                    rest = characters[at : at + self.widest]
                    token = longest[rest[: path(rest)]]
            elif (token := self.shorter[token]) < 0:
                closed.add(at)
                token = tokens.pop()
                at -= sizes[token]

    def _piece_ids(self, piece: str) -> bytes:
        found = b"".join([self.id_bytes[r] for r in self.encode_piece(piece.encode())])
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[piece] = found
        return found

    def _word_ids(self, word: str) -> bytes:
        found = self._pieces(" " + word)
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Special tokens' strings become their ids."""
        if self.special_split and any(s in text for s in self.special):
            return b"".join(
                np.array([self.special[part]], "<u4").tobytes() if part in self.special else self._plain(part)
                for part in self.special_split.split(text)
                if part
            )
        return self._plain(text)

    def _pieces(self, text: str) -> bytes:
        known, make = self.known.get, self._piece_ids
        return b"".join([known(p) or make(p) for p in self.split(text)])

    def _plain(self, text: str) -> bytes:
        """Where white space stands alone between other characters, a space starts the piece that follows it,
        so what stands between spaces can be looked up whole. Other texts are split by the pattern."""
        if CROWDED(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        known, make = self.words.get, self._word_ids
        return self._pieces(first) + b"".join([known(w) or make(w) for w in rest])

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(at):
            return ""
        start, size = self.offsets[at], self.offsets[at + 1] - self.offsets[at]
        first = np.cumsum(size) - size
        where = np.repeat(start - first, size) + np.arange(first[-1] + size[-1])
        return self.blob[where].tobytes().decode("utf-8", "replace")


def _codec(content: str) -> Codec:
    key = hash(content)
    if key not in _loaded:
        _loaded[key] = Codec(content)
    return _loaded[key]


def _shared(df: DataFrame, vocabulary: str | None):
    """The vocabulary file (a few MB, whatever the corpus) goes to the executors once."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str | None = None, decoded: bool = False) -> DataFrame:
    """Each document's token ids: doc_id, token_ids (binary, little-endian unsigned 32-bit), with
    `decoded` also the text that the ids give back.

    Null and empty texts have no ids. Texts of any length are encoded whole; rows, repeated ones too, are
    kept as they are; an empty table gives none; a text has one right encoding, so there are no ties. Columns
    other than doc_id and text, whatever their names, are neither read nor returned.
    """
    shared = _shared(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for part in byte_parts(batch, 1):
                ids = [codec.encode(t or "") for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([codec.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "token_ids", "decoded"][: len(columns)])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, token_ids binary" + (", decoded string" if decoded else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The text of each row's token_ids (null: empty): doc_id, text."""
    shared = _shared(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            texts = [codec.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "token_ids").mapInArrow(run, f"doc_id {kind}, text string")
