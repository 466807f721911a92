"""SentencePiece encoding and decoding with a unigram vocabulary.

The pieces lie in a double-array trie. From every character on, the trie gives the
pieces that begin there; Viterbi keeps for every place the best sum of log scores. A
character of no piece falls back to the pieces of its UTF-8 bytes. Decoding joins the
pieces' bytes and turns the whitespace marker back into a blank.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.registry import query
from eventloom.llm.text import read_table
from eventloom.llm.unigram import BYTE, CONTROL, MARKER, MODEL_PATH, Segments, Vocabulary
from eventloom.llm.unigram import read_vocabulary

# Words of at most so many bytes are solved so many at a time.
SHORT_WORD = 48
TOGETHER = 8192
# Ids that are looked up before their bytes are joined.
DECODED_IDS = 1 << 16
# Bytes of texts that are answered at a time; a longer text is answered alone.
ANSWER_BYTES = 1 << 20


class DoubleArray:
    """A trie over bytes in two arrays: the child of node ``s`` by byte ``b`` is
    ``t = base[s] + b + 1`` if ``check[t] == s``. ``value`` has the number of the key
    that ends at a node, else -1."""

    def __init__(self, keys: list[bytes]):
        root: dict = {}
        for number, key in enumerate(keys):
            node = root
            for byte in key:
                node = node.setdefault(byte, {})
            node[-1] = number
        self.base, self.check, self.value = array("i", [0]), array("i", [-1]), array("i", [-1])
        self.check[0] = 0
        first_free, pending = 1, [(0, root)]
        while pending:
            at, node = pending.pop()
            self.value[at] = node.get(-1, -1)
            codes = sorted(byte + 1 for byte in node if byte >= 0)
            if not codes:
                continue
            while first_free < len(self.check) and self.check[first_free] >= 0:
                first_free += 1
            base, tried = max(first_free - codes[0], 0), 0
            while not self._fits(base, codes):
                base, tried = base + 1, tried + 1
            if tried > 500:  # crowded there: leave the few free places unused
                first_free += 50
            self.base[at] = base
            for code in codes:
                self.check[base + code] = at
            pending += [(base + code, node[code - 1]) for code in codes]

    def _fits(self, base: int, codes: list[int]) -> bool:
        more = base + codes[-1] + 1 - len(self.check)
        if more > 0:
            self.base.extend([0] * more)
            self.check.extend([-1] * more)
            self.value.extend([-1] * more)
        return all(self.check[base + code] < 0 for code in codes)


class Codec:
    """Solves segments for one vocabulary; made once in each worker."""

    def __init__(self, vocabulary: Vocabulary, trie: DoubleArray):
        self.base, self.check = trie.base.tolist(), trie.check.tolist()
        self.value = trie.value.tolist()
        self.usable = [(number, score) for _, number, score in vocabulary.usable()]
        self.unknown_score = vocabulary.unknown_score
        self.unknown = vocabulary.unknown_id
        self.bytes = vocabulary.byte_ids if vocabulary.byte_fallback else None
        self.dummy_prefix = vocabulary.dummy_prefix
        self.segments = Segments(vocabulary, self._packed)
        self.arrays = tuple(np.array(a, np.int32) for a in (trie.base, trie.check, trie.value))
        self.scores = np.array([score for _, score in self.usable])
        self.numbers = np.array([number for number, _ in self.usable], np.int32)
        blank = MARKER.encode()
        self.texts = [
            bytes([int(piece[3:5], 16)]) if kind == BYTE
            else b"" if kind == CONTROL
            else piece.encode().replace(blank, b" ")
            for piece, kind in zip(vocabulary.pieces, vocabulary.kinds)
        ]

    def solve(self, segment: str) -> tuple[int, ...]:
        """Ids of the best path. Of paths with equal scores the one whose last piece
        begins first wins, place by place, as in the public implementation."""
        data = segment.encode("utf-8", "surrogatepass")
        size = len(data)
        best: list[float | None] = [None] * (size + 1)
        came: list[tuple[int, int]] = [(0, 0)] * (size + 1)
        best[0] = 0.0
        base, check, value, usable = self.base, self.check, self.value, self.usable
        limit = len(check)
        start = 0
        while start < size:
            lead = data[start]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, node, end, whole = best[start], 0, start, False
            while end < size:
                child = base[node] + data[end] + 1
                if child >= limit or check[child] != node:
                    break
                node, end = child, end + 1
                key = value[node]
                if key >= 0:
                    number, score = usable[key]
                    if best[end] is None or here + score > best[end]:
                        best[end], came[end] = here + score, (start, number)
                    whole = whole or end - start == width
            if not whole:
                end, score = start + width, here + self.unknown_score
                if best[end] is None or score > best[end]:
                    best[end], came[end] = score, (start, -1)
            start += width
        ids, end = [], size
        while end:
            start, number = came[end]
            if number >= 0:
                ids.append(number)
            elif self.bytes:
                ids += [self.bytes[byte] for byte in reversed(data[start:end])]
            else:
                ids.append(self.unknown)
            end = start
        return tuple(reversed(ids))

    def solve_all(self, words: list[str]) -> Iterator[tuple[int, ...]]:
        """As :meth:`solve` for each word, many short words at a time."""
        data = [word.encode("utf-8", "surrogatepass") for word in words]
        for at in range(0, len(words), TOGETHER):
            part = data[at : at + TOGETHER]
            short = [k for k, word in enumerate(part) if len(word) <= SHORT_WORD]
            found = dict(zip(short, self._solve_short([part[k] for k in short])))
            for k in range(len(part)):
                yield found.get(k) or self.solve(words[at + k])

    def _solve_short(self, words: list[bytes]) -> Iterator[tuple[int, ...] | None]:
        """The same steps as in :meth:`solve`, each for all words that take it; None for
        a word in whose path a character has no piece."""
        if not words:
            return
        base, check, value = self.arrays
        sizes = np.array([len(word) for word in words])
        longest = int(sizes.max())
        data = np.zeros((len(words), longest), np.int32)
        filled = np.arange(longest) < sizes[:, None]
        data[filled] = np.frombuffer(b"".join(words), np.uint8)
        best = np.full((len(words), longest + 1), -np.inf)
        best[:, 0] = 0.0
        came = np.zeros((len(words), longest + 1), np.int32)
        chosen = np.full((len(words), longest + 1), -1, np.int32)
        for start in range(longest):
            begins = filled[:, start] & ((data[:, start] & 0xC0) != 0x80)
            rows = np.flatnonzero(begins)
            lead = data[rows, start]
            width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            whole = np.zeros(len(words), bool)
            going, ahead, node = rows, width, np.zeros(len(rows), np.int32)
            for end in range(start, longest):
                within = sizes[going] > end
                going, ahead, node = going[within], ahead[within], node[within]
                child = base[node] + data[going, end] + 1
                fits = child < len(check)
                fits[fits] = check[child[fits]] == node[fits]
                going, ahead, node = going[fits], ahead[fits], child[fits]
                if not len(going):
                    break
                key = value[node]
                ends = key >= 0
                hit, key = going[ends], key[ends]
                scores = best[hit, start] + self.scores[key]
                better = scores > best[hit, end + 1]
                hit, key = hit[better], key[better]
                best[hit, end + 1] = scores[better]
                came[hit, end + 1] = start
                chosen[hit, end + 1] = self.numbers[key]
                whole[going[ends & (ahead == end + 1 - start)]] = True
            single = ~whole[rows]
            rows, ends = rows[single], start + width[single]
            scores = best[rows, start] + self.unknown_score
            better = scores > best[rows, ends]
            rows, ends = rows[better], ends[better]
            best[rows, ends] = scores[better]
            came[rows, ends] = start
            chosen[rows, ends] = -1
        at, every, steps = sizes.copy(), np.arange(len(words)), []
        while at.any():
            steps.append(np.where(at > 0, chosen[every, at], -2))
            at = came[every, at]
        for row in np.stack(steps[::-1], 1).tolist():
            yield None if -1 in row else tuple(number for number in row if number != -2)

    def _packed(self, words: list[str]) -> Iterator[bytes]:
        """Answers as they are kept: four bytes an id."""
        return (array("i", ids).tobytes() for ids in self.solve_all(words))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of every text."""
        parts: list[bytes] = []
        for answers, ends in self.segments.answers(texts):
            parts.append(b"".join(answers))
            if ends:
                yield np.frombuffer(b"".join(parts), np.int32)
                parts = []

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        parts = []
        for at in range(0, len(ids), DECODED_IDS):
            some = np.asarray(ids[at : at + DECODED_IDS]).tolist()
            parts.append(b"".join([self.texts[number] for number in some]))
        text = b"".join(parts).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_CODECS: dict[str, Codec] = {}


def _codec(key: str, vocabulary: Vocabulary, trie: DoubleArray) -> Codec:
    """The worker's codec, which serves all its tasks; the last vocabulary's is kept."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary, trie)
    return _CODECS[key]


def _codecs(vocabulary: Vocabulary):
    """Gives the codec in the worker, out of the vocabulary and the trie built here."""
    trie = DoubleArray([piece.encode() for piece, _, _ in vocabulary.usable()])
    return partial(_codec, vocabulary.key, vocabulary, trie)


@contextmanager
def _at_work(codec: Codec) -> Iterator[Codec]:
    """The codec for one task. The worker outlives it and runs other steps, so what the
    task has gathered goes with it; the trie stays."""
    try:
        yield codec
    finally:
        codec.segments.forget()
        pa.default_memory_pool().release_unused()


def _slices(batch: pa.Array) -> Iterator[pa.Array]:
    """A batch of texts or id lists in slices of bounded bytes, one row at least."""
    offsets = batch.offsets.to_numpy() if pa.types.is_list(batch.type) else None
    if offsets is None:
        lengths = pc.fill_null(pc.binary_length(batch), 0).to_numpy()
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    else:
        offsets = offsets.astype(np.int64) * 4
    start = 0
    while start < len(batch):
        end = int(np.searchsorted(offsets, offsets[start] + ANSWER_BYTES, "right")) - 1
        end = min(max(end, start + 1), len(batch))
        yield batch.slice(start, end - start)
        start = end


def _encoded(codec: Codec, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's ids begin and end, and the ids of all."""
    each, parts = [], []
    for ids in codec.encode_all(text.as_py() for text in texts):
        each.append(len(ids))
        parts.append(ids)
    offsets = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
    return offsets, np.concatenate([np.empty(0, np.int32), *parts])


def _decoded(codec: Codec, offsets: np.ndarray, flat: np.ndarray) -> pa.Array:
    bounds = zip(offsets[:-1].tolist(), offsets[1:].tolist())
    return pa.array([codec.decode(flat[a:b]) for a, b in bounds], pa.string())


def _lists(offsets: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def encoder(vocabulary: Vocabulary):
    """A function of a text column that gives the ids; null and empty texts have none."""
    make = _codecs(vocabulary)

    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with _at_work(make()) as codec:
            for batch in texts:
                for part in _slices(batch):
                    yield _lists(*_encoded(codec, part))

    return encode


def decoder(vocabulary: Vocabulary):
    """A function of an id column that gives the text; null ids give an empty one."""
    make = _codecs(vocabulary)

    @F.arrow_udf("string")
    def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = make()
        for batch in ids:
            for part in _slices(batch):
                yield _decoded(codec, part.offsets.to_numpy(), part.values.to_numpy())

    return decode


def round_trip(vocabulary: Vocabulary):
    """A function of a text column that gives the ids and the text they decode to, both
    in one worker."""
    make = _codecs(vocabulary)

    @F.arrow_udf("struct<ids array<int>, decoded string>")
    def both(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with _at_work(make()) as codec:
            for batch in texts:
                for part in _slices(batch):
                    offsets, flat = _encoded(codec, part)
                    columns = [_lists(offsets, flat), _decoded(codec, offsets, flat)]
                    yield pa.StructArray.from_arrays(columns, ["ids", "decoded"])

    return both


def encode_documents(docs: DataFrame, text: str = "text", model_path: str = MODEL_PATH):
    """Columns ``row`` (all of the input), ``ids`` and ``decoded``.

    Whole texts are encoded in one pass without a shuffle, about a megabyte of them at a
    time, and long ones part by part: a worker holds a text, its ids (four bytes each)
    and what they decode to. Scores add in double precision. Null and empty texts have no ids and decode to an empty
    text. Equal rows have equal ids, an empty table has no rows. Decoding gives the
    text back exactly unless it holds the whitespace marker itself, which reads as a
    blank.
    """
    value: Column = F.col(f"`{text}`")
    both = round_trip(read_vocabulary(model_path))(value)
    found = docs.select(F.struct("*").alias("row"), both.alias("found"))
    return found.select("row", "found.ids", "found.decoded")


@query("op5_sentencepiece")
def op5_sentencepiece(spark, sf_dir):
    found = encode_documents(read_table(spark, sf_dir, "documents"))
    exact = F.col("decoded").eqNullSafe(F.coalesce(F.col("row.text"), F.lit("")))
    return found.select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        "ids",
        "decoded",
        exact.alias("round_trip"),
    )
