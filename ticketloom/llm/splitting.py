"""Cutting oversized texts at natural boundaries, all greedy cuts at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.tokens import FOLDER, NAME, Encoder, after_wide_blank, encoded, encoder, slices, text_buffer

#: Kinds of boundary, best first; a hard cut is one between tokens of a stretch without any other.
HARD, WORD, SENTENCE, LINE, TURN, PARAGRAPH = range(6)
KINDS = ("hard", "word", "sentence", "line", "turn", "paragraph")

_SPEAKER = re.compile(rb"[^\s:][^\n:]{0,38}:(?=\s)|\[?\d{1,2}:\d{2}")
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n\x0b\x0c")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSER = np.zeros(256, bool)
_CLOSER[list(b"\"')]")] = True


def natural_boundaries(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places after a visible character and before ASCII white space in the bytes of many texts, and their kinds."""
    if len(data) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = _BLANK[data]
    place = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    end = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.append(end, len(data))[np.searchsorted(end, place, "right")]
    b1, b2, b3 = data[place - 1], data[np.maximum(place - 2, 0)], data[np.maximum(place - 3, 0)]
    wide = after_wide_blank(data, place)
    feed = (data == 10) | ((data == 13) & (np.append(data[1:], 0) != 10))
    lines = np.concatenate([[0], np.cumsum(feed)])
    lines = lines[end] - lines[place]
    wide_stop = (b3 == 0xE2) & (b2 == 0x80) & (b1 == 0xA6) | (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x82)
    stop = _STOP[b1] | (_CLOSER[b1] & _STOP[b2]) | (_CLOSER[b1] & _CLOSER[b2] & _STOP[b3]) | wide_stop
    kind = np.where(lines > 1, PARAGRAPH, np.where(lines == 1, LINE, np.where(stop, SENTENCE, WORD)))
    raw = data.tobytes()
    single = np.flatnonzero(lines == 1)
    kind[single] = [TURN if _SPEAKER.match(raw, e, e + 41) else LINE for e in end[single].tolist()]
    return place[~wide], kind[~wide]


def boundaries(text: bytes, token_ends: np.ndarray, reach: int, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, tokens, kind) of the places where text may be cut, both ends included; at, kind: its natural boundaries.

    At a natural boundary the tokenizer ends a piece whatever stands around,
    so the tokens of a part are those of the whole. In stretches of more than
    reach tokens without one, every end of a token that is one of a character
    can be a hard cut.
    """
    place = np.concatenate([[0], at, [len(text)]])
    kinds = np.concatenate([[PARAGRAPH], kind, [PARAGRAPH]])
    tokens = np.searchsorted(token_ends, place, "left") + 1
    tokens[0] = 0
    whole = np.ones(len(place), bool)
    whole[1:] = token_ends[np.minimum(tokens[1:] - 1, len(token_ends) - 1)] == place[1:]
    place, kinds, tokens = place[whole], kinds[whole], tokens[whole]
    wide = np.flatnonzero(np.diff(tokens) > reach)
    if len(wide):
        more = np.concatenate([np.arange(tokens[i] + 1, tokens[i + 1]) for i in wide.tolist()])
        where = token_ends[more - 1]
        fit = (np.frombuffer(text, np.uint8)[where] & 0xC0) != 0x80
        more, where = more[fit], where[fit]
        place, kinds, tokens = np.concatenate([place, where]), np.concatenate([kinds, np.zeros(len(more), np.int64)]), np.concatenate([tokens, more])
        order = np.argsort(place, kind="stable")
        place, kinds, tokens = place[order], kinds[order], tokens[order]
    return place, tokens, kinds


def successors(tokens: np.ndarray, kinds: np.ndarray, most: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For every boundary as the start of a piece: the boundary where it ends, and the one where the next piece starts.

    The end is the farthest boundary of the best kind that is more than half
    the limit away, else the farthest at all within the limit; the next start
    is the first boundary at or after the end less the overlap. The last
    boundary is its own successor.
    """
    n = len(tokens)
    here = np.arange(n)
    far = np.searchsorted(tokens, tokens + most, "right") - 1
    half = np.searchsorted(tokens, tokens + most // 2, "right")
    end = np.where(far > here, far, np.minimum(here + 1, n - 1))
    chosen = far >= n - 1
    end[chosen] = n - 1
    for k in range(PARAGRAPH, HARD - 1, -1):
        last = np.maximum.accumulate(np.where(kinds >= k, here, -1))[far]
        take = ~chosen & (last >= half) & (last > here)
        end[take] = last[take]
        chosen |= take
    start = np.searchsorted(tokens, tokens[end] - overlap, "left")
    start = np.minimum(np.maximum(start, here + 1), end)
    return end, np.where(end == n - 1, n - 1, start)


def greedy_starts(start: np.ndarray) -> np.ndarray:
    """All starts of the greedy cutting from boundary 0, by squaring the table of successors."""
    reached, jump = np.array([0]), start
    while True:
        grown = np.unique(np.concatenate([reached, jump[reached]]))
        if len(grown) == len(reached):
            return grown
        reached, jump = grown, jump[jump]


def pieces_of(text: bytes, ids: bytes, use: Encoder, most: int, overlap: int, at: np.ndarray | None = None, kind: np.ndarray | None = None) -> list[tuple[int, int, int, int, int]]:
    """(first byte, end byte, tokens, tokens shared with the piece before, kind of its end) of each piece."""
    if len(ids) // 4 <= most:
        return [(0, len(text), len(ids) // 4, 0, PARAGRAPH)]
    ends = np.cumsum(use.token_bytes[np.frombuffer(ids, np.int32)])
    if at is None or kind is None:
        at, kind = natural_boundaries(np.frombuffer(text, np.uint8))
    place, tokens, kinds = boundaries(text, ends, max(1, most // 4), at, kind)
    end, nxt = successors(tokens, kinds, most, overlap)
    out, before = [], 0
    for s in greedy_starts(nxt).tolist():
        e = int(end[s])
        if s == len(place) - 1:
            break
        out.append((int(place[s]), int(place[e]), int(tokens[e] - tokens[s]), max(0, before - int(tokens[s])), int(kinds[e])))
        before = int(tokens[e])
        if e == len(place) - 1:
            break
    return out


def split_oversized(
    documents: DataFrame, limits: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", other: str = "any_other",
    folder: str = FOLDER, name: str = NAME,
) -> DataFrame:
    """(id_col, source, piece_no, tokens, shared_tokens, ends_at, text): the pieces in order from 1.

    A text within max_tokens of its source is one piece. Longer ones are cut
    at paragraphs, turns, lines, sentences or words, the best kind that leaves
    a piece more than half full; where there is none, between two tokens.
    White space at a cut goes to the later piece, so the pieces less the
    shared parts are the text. Consecutive pieces share overlap_tokens tokens,
    or as near below as the boundaries allow. Sources that are not listed, and
    null, have the limits of other (without such a row, they are not cut).
    Null and empty texts have no piece; a null id is a document. limits has a
    row per source (few); a source listed twice has its smaller limits.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    rows = limits.where("source is not null and max_tokens > 0").groupBy("source").agg(F.min("max_tokens").alias("m"), F.min(F.coalesce("overlap_tokens", F.lit(0))).alias("o")).collect()
    table = {r["source"]: (int(r["m"]), max(0, min(int(r["o"]), int(r["m"]) - 1))) for r in rows}
    fallback = table.get(other, (1 << 60, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(folder, name)
        for b in slices(batches, 128):
            data, offsets = text_buffer(b.column(2))
            raw = data.tobytes()
            places, kinds = natural_boundaries(data)
            low, high = np.searchsorted(places, offsets[:-1], "right"), np.searchsorted(places, offsets[1:], "left")
            out: list[tuple] = []
            for i, (ids, a, z, source) in enumerate(zip(encoded(b.column(2), use), offsets[:-1].tolist(), offsets[1:].tolist(), b.column(1).to_pylist())):
                if a == z:
                    continue
                text = raw[a:z]
                own = slice(low[i], high[i])
                for no, (p, q, n, shared, k) in enumerate(pieces_of(text, ids, use, *table.get(source, fallback), places[own] - a, kinds[own]), 1):
                    out.append((i, no, n, shared, KINDS[k] if q < len(text) else "end", text[p:q].decode("utf-8", "replace")))
            if out:
                row, no, n, shared, ends_at, text_ = zip(*out)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(no, pa.int32()), pa.array(n, pa.int32()), pa.array(shared, pa.int32()), pa.array(ends_at), pa.array(text_)],
                    names=[id_col, "source", "piece_no", "tokens", "shared_tokens", "ends_at", "text"],
                )

    named = documents.select(F.col(id_col), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("_text"))
    return named.mapInArrow(run, f"`{id_col}` {kind}, source string, piece_no int, tokens int, shared_tokens int, ends_at string, text string")
