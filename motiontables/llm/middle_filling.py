"""Fill-in-middle texts from seekable compressed frames.

A text is stored as independent zstandard frames of at most ``FRAME_BYTES``, cut between characters, with the
running number of line ends and characters before each. A cut after so many lines lies in one frame, found in the
running counts, and only that frame is decompressed to place it; all others move to the output as they are. The
output is a row of frames as well, in the order of its form, so any prefix of it is readable, and
digests take its frames one after the other, without putting it together.

Where to cut, and whether and how to turn a text round, comes from sha256 of ``seed:doc_id``.

Defined cases: null texts are empty; empty texts, and texts that contain a mark, stay plain; a null doc_id hashes
as no digits; repeated rows give the same output each; texts without a line end are one line; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME_BYTES = 64 << 10
# Fixed values of the output format.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                    ("middle_chars", pa.int64()), ("frames", pa.list_(pa.binary()))])


@dataclass
class Stored:
    """A text as frames; ``lines`` and ``chars`` count what lies before each frame, and last what lies before the end."""

    frames: list[bytes]
    lines: np.ndarray
    chars: np.ndarray
    n: int
    marked: bool


def characters(data: bytes) -> int:
    """UTF-8 characters: every byte but the continuing ones."""
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def stored(text: bytes, squeeze: zstandard.ZstdCompressor, frame_bytes: int = FRAME_BYTES) -> Stored:
    frames, lines, chars, at, tail, marked = [], [0], [0], 0, b"", False
    while at < len(text):
        end = min(len(text), at + frame_bytes)
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        piece = text[at:end]
        joined = tail + piece  # a mark may lie across two frames
        marked = marked or any(m in joined for m in (PREFIX, SUFFIX, MIDDLE))
        tail = joined[-2:]
        frames.append(squeeze.compress(piece))
        lines.append(lines[-1] + piece.count(b"\n"))
        chars.append(chars[-1] + characters(piece))
        at = end
    n = lines[-1] + (1 if len(text) and text[len(text) - 1] != 10 else 0)
    return Stored(frames, np.array(lines), np.array(chars), n, marked)


def cut(store: Stored, after: int, loosen: zstandard.ZstdDecompressor) -> tuple[int, int, int]:
    """(frame, byte in it, characters before) of the end of the first ``after`` lines."""
    if after == 0:
        return 0, 0, 0
    if after > store.lines[-1]:
        return len(store.frames), 0, int(store.chars[-1])
    frame = int(np.searchsorted(store.lines, after)) - 1
    piece = loosen.decompress(store.frames[frame])
    ends = np.flatnonzero(np.frombuffer(piece, np.uint8) == 10)
    byte = int(ends[after - store.lines[frame] - 1]) + 1
    return frame, byte, int(store.chars[frame]) + characters(piece[:byte])


def between(store: Stored, low: tuple, high: tuple, squeeze, loosen) -> list[bytes]:
    """Frames of the text from one cut to another: whole ones as they are, cut ones anew."""
    (first, begin, _), (last, end, _) = low, high
    out = []
    for frame in range(first, min(last + 1, len(store.frames))):
        left, right = begin if frame == first else 0, end if frame == last else None
        if right == 0:
            continue
        if not left and right is None:
            out.append(store.frames[frame])
        elif piece := loosen.decompress(store.frames[frame])[left:right]:
            out.append(squeeze.compress(piece))
    return out


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50,
                   frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row per document: doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and
    ``frames``, zstandard frames whose contents make up the output in order. ``rate`` of 100 texts are turned round, ``spm``
    of 100 of these with the suffix first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, loosen = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        marks = {m: squeeze.compress(m) for m in (PREFIX, SUFFIX, MIDDLE)}

        def transformed(doc_id: int | None, text: bytes) -> tuple:
            store = stored(text, squeeze, frame_bytes)
            h = draws(doc_id, seed)
            if not store.n or store.marked or h[2] % 100 >= rate:
                return doc_id, store.n, "plain", None, None, store.frames
            a, b = sorted((h[0] % (store.n + 1), h[1] % (store.n + 1)))
            begin, low, high = (0, 0, 0), cut(store, a, loosen), cut(store, b, loosen)
            end = (len(store.frames), 0, int(store.chars[-1]))
            parts = {PREFIX: (begin, low), MIDDLE: (low, high), SUFFIX: (high, end)}
            form = "spm" if h[3] % 100 < spm else "psm"
            frames = [f for m in ORDER[form] for f in (marks[m], *between(store, *parts[m], squeeze, loosen))]
            return doc_id, store.n, form, low[2], high[2] - low[2], frames

        for batch in batches:
            out, size = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                out.append(transformed(doc_id.as_py(), text.as_buffer().to_pybytes() if text.is_valid else b""))
                size += sum(map(len, out[-1][-1]))
                if size > 8 << 20:
                    yield rows(out)
                    out, size = [], 0
            if out:
                yield rows(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>")


def rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)


def restored(frames: list[bytes], form: str, loosen: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """The text's pieces in order, from the output and its form alone: marks are found in the contents, and the part that
    comes late in the text waits in its frames."""
    if form == "plain":
        yield from map(loosen.decompress, frames)
        return
    part, parts = None, {m: [] for m in ORDER[form]}
    for frame in frames:
        content = loosen.decompress(frame) if len(frame) < 64 else b""
        if content in parts:
            part = content
        else:
            parts[part].append(frame)
    for m in (PREFIX, MIDDLE, SUFFIX):
        yield from map(loosen.decompress, parts[m])


def digests(filled: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with output_sha256 and restored_sha256 in place of the frames."""
    at = {c: filled.columns.index(c) for c in ("form", "frames")}
    kept = [c for c in filled.columns if c != "frames"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        for batch in batches:
            output, text = [], []
            for form, frames in zip(batch.column(at["form"]).to_pylist(), batch.column(at["frames"])):
                out, back = hashlib.sha256(), hashlib.sha256()
                own = frames.as_py()
                for frame in own:
                    out.update(loosen.decompress(frame))
                for piece in restored(own, form, loosen):
                    back.update(piece)
                output.append(out.hexdigest())
                text.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in kept), pa.array(output, pa.string()),
                                              pa.array(text, pa.string())], [*kept, "output_sha256", "restored_sha256"])

    types = dict(filled.dtypes)
    return filled.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "output_sha256 string", "restored_sha256 string"]))


MARK = {m: m.decode() for m in (PREFIX, SUFFIX, MIDDLE)}
SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), n AS (
  SELECT *, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END)::BIGINT AS n,
         ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[25:32])::BIGINT AS h4,
         string_split(text, chr(10)) AS parts
  FROM h
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM n
), l AS (
  SELECT *, CASE WHEN a = n THEN length(text) WHEN a = 0 THEN 0 ELSE length(array_to_string(parts[1:a], chr(10))) + 1 END AS x,
         CASE WHEN b = n THEN length(text) WHEN b = 0 THEN 0 ELSE length(array_to_string(parts[1:b], chr(10))) + 1 END AS y
  FROM c
), p AS (
  SELECT *, substring(text, 1, x) AS prefix, substring(text, x + 1, y - x) AS middle, substring(text, y + 1) AS suffix FROM l
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN (y - x)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
