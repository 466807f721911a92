"""Unigram vocabularies: reading a model file, and cutting texts where no piece crosses.

The model is a public tokenizer's file, read on the driver and sent to the tasks; its
size is bounded by the vocabulary. Nothing is trained.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"

# The whitespace marker, the kinds of piece, the penalty of a character
# without a piece.
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
KNOWN_WORDS = 100_000
SLICE_WORDS = 50_000
# Longer texts are cut into words part by part.
PART_CHARS = 1 << 18


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        length = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, data[at : at + length]
        at += length

_WORD_START = re.compile("(?<! ) ")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with log scores, and how texts are normalised before they are cut."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    byte_fallback: bool
    dummy_prefix: bool
    collapse_blanks: bool

    def usable(self) -> list[tuple[str, int, float]]:
        """Text, id and score of the pieces that a path may use."""
        best = max(s for s, k in zip(self.scores, self.kinds) if k == NORMAL)
        found = []
        for number, (piece, score, kind) in enumerate(zip(self.pieces, self.scores, self.kinds)):
            if kind == NORMAL:
                found.append((piece, number, score))
            elif kind == USER_DEFINED:
                found.append((piece, number, len(piece.encode()) * best - 0.1))
        return found

    @property
    def key(self) -> str:
        """Tells vocabularies apart in a worker."""
        return hashlib.sha256(repr(self).encode("utf-8", "surrogatepass")).hexdigest()

    @property
    def unknown_id(self) -> int:
        return self.kinds.index(UNKNOWN)

    @property
    def unknown_score(self) -> float:
        return min(s for s, k in zip(self.scores, self.kinds) if k == NORMAL) - UNKNOWN_PENALTY

    @property
    def byte_ids(self) -> list[int]:
        """Ids of the 256 byte pieces, in order of the byte."""
        found = {int(p[3:5], 16): n for n, (p, k) in enumerate(zip(self.pieces, self.kinds))
                 if k == BYTE}
        return [found[byte] for byte in range(256)]


def read_vocabulary(path: str = MODEL_PATH) -> Vocabulary:
    with open(path, "rb") as file:
        return parse_vocabulary(file.read())


def parse_vocabulary(data: bytes) -> Vocabulary:
    pieces, scores, kinds = [], [], []
    trainer, normalizer = {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    if normalizer.get(2):
        raise ValueError("this model rewrites characters before it cuts; that is not supported")
    return Vocabulary(
        tuple(pieces),
        tuple(scores),
        tuple(kinds),
        bool(trainer.get(35, 0)),
        bool(normalizer.get(3, 1)),
        bool(normalizer.get(4, 1)),
    )


class Segments:
    """Cuts texts into words that are solved one by one.

    Where no piece has the marker after another character, no path crosses the place
    before a run of markers, and none the places around a character that is in no
    longer piece. The best path of a text is then that of its words in a row, and words
    met again need not be solved again. ``solve`` takes a list of words with their
    markers. A bounded number of answers is kept; when the newer half is full, the
    older one goes. A vocabulary with pieces that cross has each text solved as a whole.
    """

    def __init__(self, vocabulary: Vocabulary, solve: Callable[[list[str]], Iterable]):
        longer = [piece for piece, _, _ in vocabulary.usable() if len(piece) > 1]
        inner = {char for piece in longer for char in piece}
        alone = "".join(f"\\x{c:02x}" for c in range(128) if chr(c) not in inner and c != 32)
        crossing = any(re.search(f"[^{MARKER}]{MARKER}", piece) for piece in longer)
        word = f"{MARKER}*[^{MARKER}{alone}]+|{MARKER}+"
        self.pattern = None if crossing else re.compile(f"{word}|[{alone}]" if alone else word)
        self.vocabulary = vocabulary
        self.solve = solve
        self.known: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def parts(self, text: str | None) -> Iterator[str]:
        """A text in parts that begin where a word does: at a blank behind another
        character. A text without such a place is one part."""
        text = (text or "").replace(MARKER, " ")
        start = 0
        while self.pattern is not None and len(text) - start > PART_CHARS:
            cut = _WORD_START.search(text, start + PART_CHARS)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:] if start else text

    def words(self, text: str, begins: bool = True) -> list[str]:
        """The words of a part as the vocabulary sees it; ``begins``: the text's first."""
        if self.vocabulary.collapse_blanks:
            text = " ".join(part for part in text.split(" ") if part)
            # The blank that the part was cut at.
            text = " " + text if text and not begins else text
        if not text:
            return []
        if self.vocabulary.dummy_prefix and begins:
            text = " " + text
        text = text.replace(" ", MARKER)
        return [text] if self.pattern is None else self.pattern.findall(text)

    def answers(self, texts: Iterable[str | None]) -> Iterator[tuple[list, bool]]:
        """For each text the answers for its words in order, a long one's in several
        lists; with the last comes True."""
        slice_, size = [], 0
        for text in texts:
            before = None
            for part in self.parts(text):
                if before is not None:
                    slice_.append((before, False))
                begins = before is None
                before = self.words(part, begins)
                size += len(before)
                if size >= SLICE_WORDS:
                    yield from self._solved(slice_)
                    slice_, size = [], len(before)
            slice_.append((before, True))
        yield from self._solved(slice_)

    def forget(self) -> None:
        """Drops the answers kept so far, which a worker would hold between its tasks."""
        self.known, self.older = {}, {}

    def _solved(self, texts: list[tuple[list[str], bool]]) -> Iterator[tuple[list, bool]]:
        if len(self.known) >= KNOWN_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = []
        for word in set().union(*(words for words, _ in texts)).difference(known):
            if word in older:
                known[word] = older[word]
            else:
                new.append(word)
        known.update(zip(new, self.solve(new)))
        for words, ends in texts:
            yield [known[word] for word in words], ends
