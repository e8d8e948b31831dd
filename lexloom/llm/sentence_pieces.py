"""SentencePiece encoding and decoding by a Viterbi pass that words with a common beginning share.

Texts are cut at blanks into marked words (the mark stands for the blank before the word).
The distinct words of a task are sorted, which lines up a trie, and the trie is walked depth
first: the best path to every prefix (its score and last piece) stays on a stack, and the
next word starts where it leaves the one before. The two kinds of model differ in what
extends a prefix:

* unigram: the piece with the best sum of scores.
* merges: the one piece that merging by rank would leave at the end of the prefix. It is the
  piece that merging leaves apart from the last piece of the prefix before it.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lexloom.llm import words

MARK = "▁"
SLICE_BYTES = 16 << 20
CACHED_WORDS = 400_000
CACHED_PAIRS = 4_000_000
_UNIGRAM, _MERGES = 1, 2


def _fields(message: bytes):
    """(number, value) of the top-level fields of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, message[at:at + size]
            at += size


class Pieces:
    """Vocabulary and rules of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = dict(_fields(model.serialized_model_proto()))
        trainer, normalizer = dict(_fields(proto.get(2, b""))), dict(_fields(proto.get(3, b"")))
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that keep the text as it is and mark blanks are supported")
        self.kind = trainer.get(3, _UNIGRAM)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id_of = {model.id_to_piece(i): i for i in plain}
        self.score = {i: model.get_score(i) for i in plain}
        self.longest = max(map(len, self.id_of))
        self.unknown = model.unk_id()
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if model.is_unknown(self.byte_id[0]):
            self.byte_id = []
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("pieces reach over a blank")
        blanks = [p for p in self.id_of if p.startswith(MARK * 2)]
        if self.kind == _MERGES and any(p.strip(MARK) or self.score[self.id_of[p]] > min(self.score.values()) for p in blanks):
            raise ValueError("runs of blanks must merge after everything else")
        # bytes of every id for decoding; control and unknown pieces are silent
        self.bytes_of = [model.id_to_piece(i).replace(MARK, " ").encode() if i in self.score else b"" for i in ids]
        for b, i in enumerate(self.byte_id):
            self.bytes_of[i] = bytes([b])
        self.lowest = min(self.score.values())
        self.marks = sorted((len(p) for p in self.id_of if set(p) == {MARK}), reverse=True)
        self._apart: dict[tuple[int, int], bool] = {}
        self._text = {i: p for p, i in self.id_of.items()}

    def fallback(self, char: str) -> list[int]:
        """Ids of a character outside the vocabulary."""
        return [self.byte_id[b] for b in char.encode()] if self.byte_id else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """Pieces left by merging the best-ranked neighbours, leftmost first, until none merge."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [(-self.score[self.id_of[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.id_of]
            if not ranks:
                break
            k = min(ranks)[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def apart(self, left: int | None, right: int) -> bool:
        """True if merging the text of two pieces (of one, if there is no left) ends in just these."""
        known = self._apart.get((left, right))
        if known is None:
            parts = [self._text[i] for i in (left, right) if i is not None]
            known = self.merged("".join(parts)) == parts
            if len(self._apart) < CACHED_PAIRS:
                self._apart[left, right] = known
        return known

    def run_of_marks(self, count: int) -> list[int]:
        """Ids of blanks in a row: equal ranks merge from the left into the longest pieces."""
        out = []
        for size in self.marks:
            while count >= size:
                out.append(self.id_of[MARK * size])
                count -= size
        return out


class Trie:
    """Depth-first walk over sorted words; the path to every prefix of the current word is kept."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def encode(self, sorted_words: list[str]):
        """Yields the ids of each word; words are marked, with one mark at the front."""
        grow = self._grow_merges if self.pieces.kind == _MERGES else self._grow_unigram
        stack: list[tuple] = [(0.0, None, 0)]  # of each prefix: score, last piece (None: a fallback character), its length
        before = ""
        for word in sorted_words:
            common = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                common += 1
            del stack[common + 1:]
            for end in range(common + 1, len(word) + 1):
                stack.append(grow(stack, word, end))
            yield self._path(stack, word)
            before = word

    def _path(self, stack, word) -> list[int]:
        out, end = [], len(word)
        while end:
            _, piece, size = stack[end]
            if piece is None:
                out.extend(reversed(self.pieces.fallback(word[end - 1])))
            else:
                out.append(piece)
            end -= size
        out.reverse()
        return out

    def _grow_merges(self, stack, word, end):
        id_of, apart = self.pieces.id_of, self.pieces.apart
        for size in range(min(self.pieces.longest, end), 0, -1):
            piece = id_of.get(word[end - size:end])
            if piece is not None and apart(stack[end - size][1], piece):  # no left piece: start of the word, or a fallback character
                return 0.0, piece, size
        return 0.0, None, 1

    def _grow_unigram(self, stack, word, end):
        best = (stack[end - 1][0] + self.pieces.lowest - 10.0, None, 1)
        for size in range(1, min(self.pieces.longest, end) + 1):
            piece = self.pieces.id_of.get(word[end - size:end])
            if piece is not None:
                score = stack[end - size][0] + self.pieces.score[piece]
                if score > best[0] or best[1] is None:
                    best = (score, piece, size)
        return best


class Encoder:
    """Ids of whole texts; words already met are remembered."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.trie = Trie(self.pieces)
        self.known: dict[str, np.ndarray] = {}

    def _words(self, marked: list[str]) -> list[np.ndarray]:
        new = sorted({w for w in marked if w not in self.known})
        fresh = dict(zip(new, (np.array(ids, np.int32) for ids in self.trie.encode(new))))
        found = [self.known[w] if w in self.known else fresh[w] for w in marked]
        if len(self.known) + len(fresh) <= CACHED_WORDS:
            self.known.update(fresh)
        return found

    def _after_blanks(self, blanks: int, word: str) -> np.ndarray:
        """Ids of a word (or of nothing, at the end of a text) after more than one blank."""
        if self.pieces.kind != _MERGES:
            return self._words([MARK * (blanks + bool(word)) + word])[0]
        ids = self._words([MARK + word])[0].tolist() if word else []
        if ids and ids[0] == self.pieces.id_of.get(MARK):
            return np.array(self.pieces.run_of_marks(blanks + 1) + ids[1:], np.int32)
        return np.array(self.pieces.run_of_marks(blanks) + ids, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]]; null and empty texts have none."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten()
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        vocabulary = coded.dictionary.to_pylist()
        hollow = np.array([not w for w in vocabulary], bool)[code] if len(code) else np.zeros(0, bool)
        n = len(code)
        last = np.zeros(n, bool)
        last[ends[1:] - 1] = True
        # blanks in a row before each part, counted within its text
        place = np.arange(n)
        start = np.repeat(ends[:-1], np.diff(ends))
        stop = np.maximum.accumulate(np.where(hollow, -1, place)) if n else place
        before = np.r_[-1, stop[:-1]] if n else stop
        blanks = place - np.maximum(before, start - 1) - 1
        unit = ~hollow | last  # blanks inside a text belong to the word after them
        empty = (np.diff(ends) == 1) & hollow[ends[:-1]] if n else np.zeros(0, bool)
        unit[ends[:-1][empty]] = False  # an empty text has no ids at all
        special = unit & ((blanks > 0) | hollow)
        keys = sorted(set(zip((blanks + hollow)[special].tolist(), code[special].tolist())))
        extra = {k: len(vocabulary) + i for i, k in enumerate(keys)}
        at = np.flatnonzero(special)
        code[at] = [extra[k] for k in zip((blanks + hollow)[at].tolist(), code[at].tolist())]
        found = self._words([MARK + w for w in vocabulary]) + [self._after_blanks(k, vocabulary[c]) for k, c in keys]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        every = np.concatenate(found) if found else np.zeros(0, np.int32)
        starts = np.cumsum(lengths) - lengths
        used = code[unit]
        size = lengths[used]
        stops = np.cumsum(size)
        ids = every[np.repeat(starts[used] - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)]
        units_before = np.r_[0, np.cumsum(unit)][ends]
        return ids, np.r_[0, stops][units_before]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of ids; the blank of the first mark is taken off, broken byte sequences become U+FFFD."""
        table = self.pieces.bytes_of
        if ids.size and (ids.min() < 0 or ids.max() >= len(table)):
            raise ValueError("an id is not in the vocabulary")
        return [b"".join([table[i] for i in ids[a:b].tolist()]).decode("utf-8", "replace").removeprefix(" ") for a, b in zip(bounds[:-1], bounds[1:])]


_encoders: dict[str, Encoder] = {}  # one per worker process


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    return batch.set_column(at, name, values) if at >= 0 else batch.append_column(name, values)


def _result_schema(df: DataFrame, name: str, kind: str):
    fields = [f"`{f.name}` {kind if f.name == name else f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join(fields + ([] if name in df.columns else [f"`{name}` {kind}"]))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) of the whole ``text``.

    Null and empty texts get an empty array. Other columns pass through, a former ``ids`` is
    replaced; repeated rows are encoded one by one; an empty table gives no rows.
    """
    def run(batches):
        encoder = _encoder(path)
        for batch in words.slices(batches, max_bytes=SLICE_BYTES):
            ids, bounds = encoder.encode(batch.column("text"))
            yield _with_column(batch, "ids", pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)))
    return docs.mapInArrow(run, _result_schema(docs, "ids", "array<int>"))


def decode(encoded: DataFrame, path: str, out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``ids`` in the column ``out``; null ids give a null text."""
    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.flatten().to_numpy()
            texts = encoder.decode(ids, bounds - bounds[0])
            missing = lists.is_null().to_numpy(zero_copy_only=False)
            yield _with_column(batch, out, pa.array(texts, pa.string(), mask=missing))
    return encoded.mapInArrow(run, _result_schema(encoded, out, "string"))
