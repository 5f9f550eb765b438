"""Licence texts and notices in documents, by Dice coefficient over word bigrams.

Texts are normalised to words in lower case, without copyright statements. Compared are all runs of neighbouring
pieces, where pieces end at line and sentence ends: so single lines, sentences, paragraphs, several paragraphs and
whole texts. With a least coefficient t and a template of b distinct bigrams, a run of fewer than t / (2 - t) * b
or more than (2 - t) / t * b distinct bigrams can't reach t, nor can a text that holds under b * t / (2 - t) of
the template's own. A run does best if its first and last piece touch the template.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .licence_templates import TEMPLATES

LEAST = 0.8

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: What ends a piece, between two words.
_END = re.compile(r"\n|[.;:!?][\"')]*\s")
#: Who holds a copyright and since when differs from copy to copy and isn't part of a licence: up to the
#: sentence's or the line's end, with the reservation of rights that often follows.
_VARIES = re.compile(r"\bcopyright (?:\(c\)|©|\d{4}).*?(?:\.(?=\s)|$)(?:[^\S\n]*all rights reserved\.?)?", re.M)


def bigrams(text: str) -> set[tuple[str, str]]:
    words = _WORD.findall(text)
    return set(zip(words, words[1:]))


def normalised(text: str) -> str:
    return _VARIES.sub("", text.lower())


def pieces(text: str) -> tuple[list[str], list[int]]:
    """Words of a normalised text, and the number of the piece that each is in."""
    words, piece, now, at = [], [], 0, 0
    for m in _WORD.finditer(text):
        if words and _END.search(text, at, m.start()):
            now += 1
        words.append(m.group())
        piece.append(now)
        at = m.end()
    return words, piece


class Templates:
    def __init__(self, texts: dict[str, list[str]], least: float = LEAST):
        self.least = least
        self.sets = [(name, bigrams(normalised(t))) for name, variants in sorted(texts.items()) for t in variants]
        self.bounds = [(least / (2 - least) * len(s), (2 - least) / least * len(s)) for _, s in self.sets]
        self.holders = defaultdict(list)
        for k, (_, s) in enumerate(self.sets):
            for pair in s:
                self.holders[pair].append(k)

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(licence, first word, words, coefficient): for each licence its nearest run of pieces; of equal ones
        the longest, then the first. Words are counted in the normalised text."""
        text = normalised(text)
        words = _WORD.findall(text)
        shared = self.holders.keys() & set(zip(words, words[1:]))
        held = Counter(k for pair in shared for k in self.holders[pair])
        likely = [k for k, n in held.items() if n >= self.bounds[k][0]]
        if not likely:
            return []
        words, piece = pieces(text)
        starts = [w for w in range(len(words)) if not w or piece[w] != piece[w - 1]] + [len(words)]
        pairs = list(zip(words, words[1:]))
        found: dict[str, tuple[float, int, int]] = {}
        for k in likely:
            name = self.sets[k][0]
            for run in self.runs(k, pairs, piece, starts):
                found[name] = max(found.get(name, run), run)
        return [(name, -first, n, dice) for name, (dice, n, first) in sorted(found.items())]

    def runs(self, k: int, pairs: list, piece: list[int], starts: list[int]) -> Iterator[tuple[float, int, int]]:
        """Coefficient, words and minus the first word of the runs near enough to a template."""
        (_, theirs), (low, high) = self.sets[k], self.bounds[k]
        touched = sorted({p for w, pair in enumerate(pairs) if pair in theirs for p in (piece[w], piece[w + 1])})
        for n, first in enumerate(touched):
            own, same, at = set(), 0, starts[first]
            for last in touched[n:]:
                for pair in pairs[at : starts[last + 1] - 1]:
                    if pair not in own:
                        own.add(pair)
                        same += pair in theirs
                at = max(at, starts[last + 1] - 1)
                if len(own) > high:
                    break
                if len(own) >= low and (dice := 2 * same / (len(own) + len(theirs))) >= self.least:
                    yield dice, starts[last + 1] - starts[first], -starts[first]


def licences(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, licence, first_word, n_words and dice for every licence found in a document.

    Null, empty and wordless texts give nothing; an empty table gives none; texts of any length are read whole;
    repeated rows are each reported; a licence that several runs show is reported once, with the nearest (ties:
    the longest, then the first). Columns besides doc_id and text, whatever their names, aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(shared.value, least)
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for row in known.scan(text) if text else ():
                    at.append(k)
                    rows.append(row)
            name, first, n, dice = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())), pa.array(name, pa.string()),
                    pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(dice, pa.float64()),
                ],
                ["doc_id", "licence", "first_word", "n_words", "dice"],
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, licence string, first_word long, n_words long, dice double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
