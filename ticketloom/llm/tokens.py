"""Encoding with a public byte-level tokenizer, reusing content-defined chunks.

A text is cut at safe places where a rolling hash of the bytes before has a chosen
residue, so equal passages of different documents give equal chunks. Each
Python worker encodes a chunk once and keeps its ids (in a cache of bounded
size). A safe place lies between a character that is no white space and ASCII
white space, or between an ASCII letter and a digit: there the tokenizer
always ends a piece, and the chunks' ids can be joined as they are. Long
stretches without such a place are cut by the rolling hash where a letter
stands beside another character, and those joins are repaired: pieces around
the join are encoded again until their boundaries agree with those of the
chunk that follows. Only the last pieces before a join are kept for that, so
the time is in proportion to the text. The result equals encoding the whole
text, without a shuffle.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files.
FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Fixed value: how this tokenizer cuts a text into pieces before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: One safe place in so many ends a chunk.
EVERY = 16
#: A chunk without a safe place is cut anyway beyond this many bytes.
LONGEST = 8192
#: Bytes between two such cuts at least.
APART = 2048
#: Chunks that a worker keeps, in each of two generations.
KEPT = 150_000

_PIECES = regex.compile(PATTERN)
_encoders: dict[str, Encoder] = {}


class Encoder:
    """One per Python worker and vocabulary."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        self._encode = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.token_bytes[rank] = len(token)
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self.asked = self.encoded = 0

    def plain(self, text: bytes) -> list[int]:
        return self._encode(text.decode("utf-8", "replace"))

    def chunk(self, text: bytes) -> bytes:
        """The ids of a chunk as bytes of int32."""
        self.asked += 1
        found = self._young.get(text)
        if found is None:
            found = self._old.pop(text, None)
            if found is None:
                self.encoded += 1
                found = np.array(self.plain(text), np.int32).tobytes()
            if len(text) <= LONGEST:
                if len(self._young) >= KEPT:
                    self._old, self._young = self._young, {}
                self._young[text] = found
        return found

    def repaired(self, a: bytes, ids_a: bytes, b: bytes, ids_b: bytes) -> bytes:
        """The ids of a + b, where the tokenizer need not end a piece between them."""
        left, right = a.decode("utf-8", "replace"), b.decode("utf-8", "replace")
        starts = [m.start() for m in _PIECES.finditer(left)]
        begin = starts[-2] if len(starts) > 2 else 0
        own = {m.start(): m.group() for m in _PIECES.finditer(right)}
        again: list[int] = []
        meet = len(right)
        for m in _PIECES.finditer(left + right, begin):
            if m.start() >= len(left) and m.start() - len(left) in own:
                meet = m.start() - len(left)
                break
            again += self._encode(m.group())  # piece by piece: what white space does depends on what follows
        tail = len(self._encode(left[begin:]))
        head = sum(len(self._encode(piece)) for at, piece in own.items() if at < meet)
        return ids_a[: len(ids_a) - 4 * tail] + np.array(again, np.int32).tobytes() + ids_b[4 * head :]

    def settled(self, text: bytes, ids: bytes) -> tuple[bytes, bytes, bytes]:
        """The ids that no text to come can change; and the last three pieces of text with their ids."""
        whole = text.decode("utf-8", "replace")
        starts = [m.start() for m in _PIECES.finditer(whole)]
        if len(starts) <= 3:
            return b"", text, ids
        last = whole[starts[-3] :]
        n = len(ids) - 4 * len(self._encode(last))
        return ids[:n], last.encode(), ids[n:]

    def document(self, data: bytes, cuts: list[int], safe: list[bool]) -> bytes:
        """The ids of data, cut before each of cuts; safe: which joins need no repair."""
        if not cuts:
            return self.chunk(data) if data else b""
        out, begin = [], 0
        held_text, held = b"", b""
        for cut, sound in zip([*cuts, len(data)], [*safe, True]):
            piece = data[begin:cut]
            ids = self.chunk(piece)
            if held_text:
                ids = self.repaired(held_text, held, piece, ids)
                piece = held_text + piece
            if sound:
                out.append(ids)
                held_text = held = b""
            else:
                done, held_text, held = self.settled(piece, ids)
                out.append(done)
            begin = cut
        return b"".join(out)


def encoder(folder: str = FOLDER, name: str = NAME) -> Encoder:
    path = os.path.join(folder, name + ".tiktoken")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, and where each text begins and the last ends. Nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]  # a slice shares the buffer of its batch


def after_wide_blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is white space of two or three bytes."""
    b1, b2, b3 = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b3 == 0xE2) & (b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF)))
    return wide | ((b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)) | ((b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F)) | ((b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80))


def cut_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places before which to cut, in order, and whether each is safe."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    blank = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
    digit = (data >= 48) & (data < 58)
    letter = ((data | 32) >= 97) & ((data | 32) < 123)
    at = np.flatnonzero((blank[1:] & ~blank[:-1]) | (digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1])) + 1
    at = at[~after_wide_blank(data, at)]
    h = np.zeros(len(at), np.uint32)
    for k in range(1, 7):  # the rolling hash over six bytes before the place
        h = h * np.uint32(2654435761) + data[np.maximum(at - k, 0)]
    h ^= h >> np.uint32(15)
    picked = at[(h * np.uint32(2246822519) >> np.uint32(16)) % EVERY == 0]
    #: What is still longer than LONGEST is cut by a hash of the bytes where a letter stands beside another character.
    edges = np.unique(np.concatenate([offsets, picked]))
    forced = []
    for i in np.flatnonzero(np.diff(edges) > LONGEST):
        lo, hi = int(edges[i]), int(edges[i + 1])
        text = data[lo:hi].tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        begin = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))[:-1]
        alpha = np.fromiter(map(str.isalpha, text), bool, len(text))
        place = begin[alpha[1:] != alpha[:-1]]
        place = place[place >= 4]
        own = data[lo:hi].astype(np.uint32)
        g = own[place - 1] * np.uint32(40503) + own[place - 2] * np.uint32(30011) + own[place - 3] * np.uint32(7919) + own[place - 4] * np.uint32(104729)
        place = place[(g * np.uint32(2654435761) >> np.uint32(16)) % EVERY == 0]
        last, kept = 0, []
        for p in place.tolist():
            if p - last >= APART:
                kept.append(p)
                last = p
        forced.append(np.array(kept, np.int64) + lo)
    places = np.concatenate([picked, *forced]).astype(np.int64)
    safe = np.concatenate([np.ones(len(picked), bool), *[np.zeros(len(x), bool) for x in forced]])
    order = np.argsort(places)
    return places[order], safe[order]


def encoded(column: pa.Array, use: Encoder) -> Iterator[bytes]:
    """The ids of each text of a column as bytes of int32."""
    data, offsets = text_buffer(column)
    places, safe = cut_places(data, offsets)
    raw = data.tobytes()
    low, high = np.searchsorted(places, offsets[:-1], "right"), np.searchsorted(places, offsets[1:], "left")
    places_, safe_ = places.tolist(), safe.tolist()
    for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), low.tolist(), high.tolist()):
        yield use.document(raw[a:b], [p - a for p in places_[i:j]], safe_[i:j])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(id_col, ids): the list of ids of each text without special tokens, one row per row of df.

    Null and empty texts give an empty list; strings that look like special
    tokens are ordinary text; a null id stays null; equal rows stay as many;
    other columns are ignored. A map over the rows: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(folder, name)
        for b in slices(batches):
            ids = list(encoded(b.column(1), use))
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text_col: str = "text", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """The columns of keep and tokens, the number of ids of each text (0 for null and empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(folder, name)
        for b in slices(batches):
            n = [len(x) // 4 for x in encoded(b.column(len(keep)), use)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("_text")).mapInArrow(run, kinds + ", tokens bigint")
