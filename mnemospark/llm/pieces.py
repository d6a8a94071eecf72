"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes symbols, one for each character; an agenda holds each pair of neighbours whose join is a piece,
best score first and leftmost among equals; the top pair is joined and its new pairs go on the agenda until none is
left. Symbols that are no piece fall back to byte pieces. Pairs on two sides of a boundary that no piece of the
vocabulary spans never meet on the agenda, so a text is cut there and each distinct segment is merged once for each
worker. Every new word's ids are compared with those of the sentencepiece library inside the Arrow batch.

Nulls count as empty texts; an empty text has no ids and decodes to an empty text. Rows are kept as they come,
repeated ones too. Only pieces of the kinds normal, unknown, control and byte are taken; a model with others, or one
that rewrites characters, raises ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

SPACE = "▁"
#: Distinct words that a worker remembers before it starts afresh.
REMEMBERED = 1_400_000
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")
_LIVE: dict[bytes, Merger] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message, in order."""
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
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


class Merger:
    """A vocabulary, ready to encode and decode words."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.prefix = True
        scores = []
        for number, value in _fields(model):
            if number == 1:
                entry = dict(_fields(value))
                self.pieces.append(entry[1].decode())
                scores.append(struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0)
                self.kinds.append(entry.get(3, 1))
            elif number == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("the vocabulary isn't of the merge type")
            elif number == 3:
                spec = dict(_fields(value))
                self.prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("the model rewrites its texts before merging")
        if set(self.kinds) - {1, 2, 3, 6} or not self.prefix:
            raise ValueError("the model has pieces of other kinds or no leading space")
        self.score = {p: (-s, i) for i, (p, s, k) in enumerate(zip(self.pieces, scores, self.kinds, strict=True)) if k == 1}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        self.inner = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        if any(a != SPACE and b == SPACE for a, b in self.inner):
            raise ValueError("a piece spans the start of a word")
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        self.ids_of: dict[str, str] = {}
        self.exact = True  # each segment so far decodes to itself
        self._segments: dict[str, str] = {}

    def merge(self, text: str) -> tuple[int, ...]:
        """The ids of one segment by the agenda."""
        score, parts, n = self.score, list(text), len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            if found := score.get(parts[i] + parts[i + 1]):
                agenda.append((found[0], i, i + 1, len(parts[i]) + len(parts[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            a, b = parts[left], parts[right]
            if not a or not b or len(a) + len(b) != size or after[left] != right:
                continue
            parts[left], parts[right] = a + b, ""
            nxt = after[left] = after[right]
            if nxt >= 0:
                before[nxt] = left
                if found := score.get(parts[left] + parts[nxt]):
                    heapq.heappush(agenda, (found[0], left, nxt, size + len(parts[nxt])))
            prev = before[left]
            if prev >= 0 and (found := score.get(parts[prev] + parts[left])):
                heapq.heappush(agenda, (found[0], prev, left, size + len(parts[prev])))
        out: list[int] = []
        for part in parts:
            if part:
                found = score.get(part)
                out += [found[1]] if found else [self.bytes[b] for b in part.encode()]
        return tuple(out)

    def word(self, text: str) -> tuple[str, bool]:
        """The joined ids of a word with its leading spaces, cut where no piece can span; whether a segment was new."""
        out, start, known, new, inner = [], 0, self._segments, False, self.inner
        for end in [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in inner] + [len(text)]:
            segment = text[start:end]
            ids = known.get(segment)
            if ids is None:
                ids = known[segment] = ",".join(map(str, self.merge(segment)))
                new = True
            out.append(ids)
            start = end
        return ",".join(out), new

    def decode(self, ids) -> str:
        """The text of ids, as it stands inside a text: the leading space stays."""
        out, pending = [], bytearray()
        for i in ids:
            if self.kinds[i] == 6:
                pending.append(int(self.pieces[i][3:5], 16))
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending.clear()
            out.append(" ⁇ " if self.kinds[i] == 2 else "" if self.kinds[i] == 3 else self.pieces[i].replace(SPACE, " "))
        if pending:
            out.append(pending.decode(errors="replace"))
        return "".join(out)

    def learn(self, words: set[str]) -> None:
        """Merges words that are new; each word that brings a new segment is compared with the library."""
        if len(self.ids_of) + len(words) > REMEMBERED:
            self.ids_of.clear()
            self._segments.clear()
        fresh = []
        for word in words:
            if word not in self.ids_of:
                ids, new = self.word(SPACE + word)
                self.ids_of[word] = ids
                if new:
                    fresh.append(word)
        # The library adds a space in front of each text, as the words here lack theirs; an empty text gets none.
        for word, expected in zip(fresh, self.library.encode([w.replace(SPACE, " ") for w in fresh], num_threads=1) if fresh else [], strict=True):
            ids = [int(x) for x in self.ids_of[word].split(",")]
            if ids != expected and word:
                raise RuntimeError(f"ids of {word!r} differ from the library's: {ids} and {expected}")
            self.exact = self.exact and self.decode(ids) == " " + word.replace(SPACE, " ")

    def text(self, words: list[str]) -> str:
        """What the ids of these words decode to."""
        if not self.exact:
            return self.decode(int(i) for w in words for i in self.ids_of[w].split(","))[1:]
        return " ".join(words).replace(SPACE, " ")

    def words(self, text: str) -> list[str]:
        """The words of a text, each with the spaces before it but for the first."""
        if not text:
            return []
        if "  " in text or text[0] in (" ", SPACE) or SPACE in text:
            return [w[1:] for w in _WORDS.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")


def merger(model: bytes) -> Merger:
    if model not in _LIVE:
        _LIVE.clear()
        _LIVE[model] = Merger(model)
    return _LIVE[model]


def encode(df: DataFrame, model_path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """Adds `ids` (array<int>) and `decoded` (string), or with digest `n_tokens`, `ids_sha256`, `decoded_sha256`.

    Columns of df that have those names are replaced.
    """
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
    kept = [c for c in df.columns if c not in added and (c != text or not digest)]
    source = df.select(*kept, df[text].alias("__text"))
    types = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType())}
    schema = T.StructType([*(source.schema[c] for c in kept), *(T.StructField(c, types.get(c, T.StringType())) for c in added)])
    common.text_batches(df.sparkSession)
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't grow with the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model.value)
        for batch in common.settle(batches):
            columns: list[list] = [[] for _ in added]
            for value in batch.column(len(kept)):
                words = m.words(value.as_py() or "")
                try:
                    ids = list(map(m.ids_of.__getitem__, words))
                except KeyError:
                    m.learn(set(words))
                    ids = list(map(m.ids_of.__getitem__, words))
                joined, back = ",".join(ids), m.text(words)
                if digest:
                    row = (joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
                else:
                    row = (list(map(int, joined.split(","))) if joined else [], back)
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            arrays = [pa.array(c, type=pa.int64() if n == "n_tokens" else pa.list_(pa.int32()) if n == "ids" else pa.string()) for n, c in zip(added, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], names=[*kept, *added])

    return source.mapInArrow(run, schema)
