"""SentencePiece encoding and decoding by a streaming Viterbi lattice.

A text is normalised as the model says (dummy prefix, spaces as U+2581) and walked left to right. Every
position keeps one backpointer, the piece that ends there on the best path; only paths that can still grow
(those ending within the longest piece of the current position) survive, and ids are committed as soon as
all survivors share a boundary, so the window never holds more than the undecided stretch.

* Unigram models keep the backpointer with the highest score sum.
* BPE models keep the piece that is compatible with the piece before it: merging the two texts by rank gives
  these two pieces back. Exactly one piece is compatible at a position, and following the backpointers gives
  the merges' own result, so ids equal those of rank-order merging.

Characters without a piece fall back to byte pieces, or to the unknown id where a model has none.
Null and empty texts give no ids. Decoding gives the text back, but for U+2581 itself, which reads as a space.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyforge.llm.shared import sliced

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Memo sizes in entries; what a full memo forgets costs time only.
SEGMENTS, PAIRS = 150_000, 500_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = number()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """Pieces, scores and flags of a serialised model."""

    def __init__(self, data: bytes, kind: int | None = None):
        self.texts: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.texts.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        self.kind = kind or trainer.get(3, UNIGRAM)
        self.dummy_prefix = bool(normalizer.get(3, 1))
        if normalizer.get(4, 1) or normalizer.get(2, b""):
            raise ValueError("only models with identity normalisation that keep white space are supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.types)) if k in (NORMAL, USER)}
        self.longest = max(map(len, self.ids))
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.types)) if k == BYTE}
        #: Score of a character without a piece: ten below the worst piece.
        self.unseen = min(self.scores[i] for i in self.ids.values()) - 10.0
        #: Nested by character: [id of the piece that ends there or -1, what may follow].
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node, here = [-1, self.trie], self.trie
            for character in piece:
                node = here.setdefault(character, [-1, {}])
                here = node[1]
            node[0] = i
        self.decoded = [
            bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.replace(MARK, " ").encode()
            for t, k in zip(self.texts, self.types)
        ]
        #: A text may be cut before any run of marks, and around a line feed that no piece holds.
        inner = any(MARK in t.lstrip(MARK) for t in self.ids)
        feed = any("\n" in t for t in self.ids)
        self.plain = self.dummy_prefix and not inner and not feed
        self.cut = re.compile(r"(?s).+" if inner else f"{MARK}+[^{MARK}]*|[^{MARK}]+" if feed else f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")


class Codec:
    """Encoder and decoder with bounded memos."""

    def __init__(self, model: Model):
        self.model = model
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._pairs: dict[int, dict[int, bool]] = {}
        self._count = 0
        self._splits: dict[str, tuple[str, str] | None] = {}
        self.widest = 0  # the longest window so far, in characters

    def _merged(self, text: str) -> tuple[list[str], list[str]]:
        """Rank-order merging of a short text, and the parts just before its last merge."""
        ids, scores = self.model.ids, self.model.scores
        parts, last = list(text), []
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                piece = ids.get(parts[k] + parts[k + 1])
                if piece is not None and (best is None or scores[piece] > best):
                    best, at = scores[piece], k
            if best is None:
                break
            last = list(parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def _split(self, text: str) -> tuple[str, str] | None:
        """The two parts that the last merge of a piece joins; None for one character or a piece that merging never makes."""
        if text not in self._splits:
            parts, last = self._merged(text)
            self._splits[text] = tuple(last) if parts == [text] and len(last) == 2 else None
        return self._splits[text]

    def _fits(self, known: dict[int, bool], before: int, piece: int) -> bool:
        """Whether ``piece`` may follow ``before`` (-1: a boundary that nothing merges across)."""
        texts = self.model.texts
        right = texts[piece]
        if before < 0 or MARK in right[:1] or MARK == texts[before][-1]:
            want = [right] if before < 0 else [texts[before], right]
            fit = self._merged("".join(want))[0] == want
        else:
            fit = (len(right) == 1 or self._split(right) is not None) and self._apart(texts[before], right)
        known[piece] = fit
        self._count += 1
        if self._count >= PAIRS:
            self._count = 0
            self._pairs.clear()
        return fit

    def _apart(self, left: str, right: str) -> bool:
        """Whether merging keeps the boundary between two pieces.

        Merges are undone one by one, the latest first, on whichever side made it; the boundary falls if what
        then touches it could have merged before the merge undone last.
        """
        ids, scores = self.model.ids, self.model.scores
        limit, ours = None, False  # score of the merge undone last, and whether it was on the left of the boundary
        while True:
            joint = ids.get(left + right)
            if joint is not None:
                # Of equal ranks the leftmost merges first: the joint one comes before one on its right only.
                if limit is None or scores[joint] > limit or scores[joint] == limit and not ours:
                    return False
            a, b = self._split(left) if len(left) > 1 else None, self._split(right) if len(right) > 1 else None
            if a is None and b is None:
                return True
            if b is None or a is not None and scores[ids[left]] < scores[ids[right]]:
                limit, ours, left = scores[ids[left]], True, a[1]
            else:
                limit, ours, right = scores[ids[right]], False, b[0]

    def _steps(self, text: str) -> Iterator[tuple[int, int]]:
        """(end, piece) of the committed pieces of a text, in order; piece -1 is a character without one."""
        model, fits = self.model, self._pairs
        scores, longest, trie, bpe = model.scores, model.longest, model.trie, model.kind == BPE
        done, total = 0, len(text)
        size = [0] * min(total + 1, 3 * longest)  # of the piece ending at done + k: the window
        self.widest = max(self.widest, len(size))
        piece_at = [-1] * len(size)
        score: list[float | None] = [None] * len(size)
        score[0] = 0.0
        for j in range(total):
            if j - done >= 2 * longest and j % longest == 0:
                meet = self._meeting(size, done, set(range(j - longest + 1, j + 1)))
                if meet > done:
                    yield from self._path(size, piece_at, done, meet)
                    shift = meet - done
                    size, piece_at, score = size[shift:], piece_at[shift:], score[shift:]
                    done = meet
            at = j - done
            if len(size) <= at + longest and len(size) <= total - done:
                more = longest
                size += [0] * more
                piece_at += [-1] * more
                score += [None] * more
                self.widest = max(self.widest, len(size))
            before, value = piece_at[at], score[at]
            known = fits.get(before)
            if known is None:
                known = fits[before] = {}
            node, alone = trie, True
            for k, character in enumerate(text[j : j + longest], at + 1):
                child = node.get(character)
                if child is None:
                    break
                piece, node = child
                if piece < 0:
                    continue
                if k == at + 1:
                    alone = False
                if bpe:
                    fit = known.get(piece)
                    if fit is None:
                        fit = self._fits(known, before, piece)
                    if fit:
                        size[k], piece_at[k], score[k] = k - at, piece, 0.0
                elif score[k] is None or value + scores[piece] > score[k]:
                    size[k], piece_at[k], score[k] = k - at, piece, value + scores[piece]
            if alone and (score[at + 1] is None or not bpe and value + model.unseen > score[at + 1]):
                size[at + 1], piece_at[at + 1], score[at + 1] = 1, -1, value + model.unseen
        yield from self._path(size, piece_at, done, total)

    @staticmethod
    def _meeting(size: list[int], done: int, ends: set[int]) -> int:
        """The last boundary that the paths to all ``ends`` share: the furthest path steps back until they meet."""
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(max(done, end - size[end - done]))
        return ends.pop()

    @staticmethod
    def _path(size: list[int], piece_at: list[int], done: int, end: int) -> list[tuple[int, int]]:
        steps = []
        while end > done:
            steps.append((end, piece_at[end - done]))
            end -= size[end - done]
        return steps[::-1]

    def _whole(self, text: str) -> list[int]:
        """The pieces of a BPE stretch that fits into the window: nothing is committed before its end. A character
        without a piece is less than zero: its end, negated."""
        fits, trie, longest, total = self._pairs, self.model.trie, self.model.longest, len(text)
        begin, piece_at = [0] * (total + 1), [-1] * (total + 1)
        for j in range(total):
            before = piece_at[j]
            known = fits.get(before)
            if known is None:
                known = fits[before] = {}
            node = trie.get(text[j])
            if node is None:
                begin[j + 1] = j
                continue
            piece, node = node
            k = j + 1
            last = total if total < j + longest else j + longest
            if piece < 0:
                begin[k] = j
            while True:
                if piece >= 0:
                    fit = known.get(piece)
                    if fit is None:
                        fit = self._fits(known, before, piece)
                    if fit:
                        begin[k], piece_at[k] = j, piece
                if k >= last:
                    break
                node = node.get(text[k])
                if node is None:
                    break
                piece, node = node
                k += 1
        out, end = [], total
        while end:
            out.append(piece_at[end] if piece_at[end] >= 0 else -end)
            end = begin[end]
        out.reverse()
        return out

    def _segment(self, key: str) -> bytes:
        model = self.model
        segment = key[1:] if key[0] == "\0" else key if key[0] == "\n" else MARK + key
        if model.kind == BPE and len(segment) <= 3 * model.longest:
            steps = [(-x, -1) if x < 0 else (0, x) for x in found] if min(found := self._whole(segment)) < 0 else None
            if steps is None:
                return array("i", found).tobytes()
        else:
            steps = self._steps(segment)
        out: list[int] = []
        for end, piece in steps:
            if piece >= 0:
                out.append(piece)
            else:
                raw = segment[end - 1].encode()
                out.extend([model.bytes[b] for b in raw] if model.bytes else [model.unknown])
        return array("i", out).tobytes()

    def _segments(self, text: str) -> list[str]:
        """Memo keys of the stretches that no piece crosses, in order.

        Single spaces, the usual case, need no pattern: a key is then a word without its mark, or a line feed and
        the word after it. Other texts are cut by pattern; their keys are NUL and the stretch as normalised.
        """
        model = self.model
        if model.plain and MARK not in text and "\0" not in text:
            words = text.replace("\n", " \n").split(" ")
            if "" not in words:
                return words
        flat = text.replace(" ", MARK)
        return ["\0" + x for x in model.cut.findall(MARK + flat if model.dummy_prefix else flat)]

    def _remember(self, segment: str) -> bytes:
        ids = self._old.get(segment)
        if ids is None:
            ids = self._segment(segment)
        if len(segment) <= 64:
            if len(self._young) >= SEGMENTS:
                self._old = dict(self._young)
                self._young.clear()
            self._young[segment] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        young = self._young
        segments = self._segments(text)
        try:
            out = list(map(young.__getitem__, segments))
        except KeyError:
            out = [young.get(x) or self._remember(x) for x in segments]
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        out = b"".join(map(self.model.decoded.__getitem__, ids)).decode(errors="replace")
        return out[1:] if self.model.dummy_prefix and out.startswith(" ") else out


_CODECS: dict[int, Codec] = {}


def _codec(data: bytes) -> Codec:
    """One codec for each model and Python worker, so that memos outlive a task."""
    key = hash(data)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(Model(data))
    return _CODECS[key]


def _model_bytes(df: DataFrame, path: str):
    """The model file, read once by the driver and broadcast: a vocabulary file has a fixed size."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _id_lists(ids: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    sizes = np.array([len(x) for x in ids], dtype=np.int32)
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat)), pa.array(sizes)


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int) and ``n_ids`` to every row; rows, order within tasks and columns are kept.

    Null and empty texts get no ids. Columns of these names that are there already are replaced.
    """
    model = _model_bytes(docs, model_path)
    kept = [c for c in docs.columns if c not in ("ids", "n_ids")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("n_ids", T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in sliced(batches, text):
            where = batch.schema.get_field_index(text)
            lists, sizes = _id_lists([codec.encode(t.as_py()) for t in batch.column(where)])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], lists, sizes], names=[*kept, "ids", "n_ids"])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str = DEFAULT_MODEL, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text of every row's ids as column ``into``; null ids give a null text."""
    model = _model_bytes(encoded, model_path)
    kept = [c for c in encoded.columns if c != into]
    schema = T.StructType([*[encoded.schema[c] for c in kept], T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in sliced(batches, ids):
            lists = batch.column(batch.schema.get_field_index(ids))
            texts = [codec.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(texts, pa.string())], names=[*kept, into])

    return encoded.select(*kept).mapInArrow(run, schema)


def round_trips(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_ids, ids and round_trip of (doc_id, text): encoded and decoded again by one worker, with one model."""
    model = _model_bytes(docs, model_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in sliced(batches, "text"):
            ids, same = [], []
            for t in batch.column(1):
                raw = t.as_py() or ""
                ids.append(codec.encode(raw))
                same.append(codec.decode(ids[-1].tolist()) == raw.replace(MARK, " "))
            lists, sizes = _id_lists(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, lists, pa.array(same)], names=["doc_id", "n_ids", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_ids int, ids array<int>, round_trip boolean")


def encode_query(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_ids, ids, and whether decoding the ids gives the text back."""
    return round_trips(docs, model_path)
