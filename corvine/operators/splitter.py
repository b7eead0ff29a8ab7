"""Recursive character splitting of long texts into overlapping chunks.

A text is cut at the coarsest separator it has (blank line, line end, space, then anywhere); the separator stays at the
front of the piece behind it. Pieces that are too long are split again by finer separators, and runs of short ones are
merged into chunks of at most ``size`` characters, each beginning with up to ``overlap`` characters of the one before.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.config import DEFAULTS

SEPARATORS = ("\n\n", "\n", " ", "")


def cut(text: str, separator: str) -> list[str]:
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + x for x in rest)) if p]


def merged(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        if window and held + len(piece) > size:
            if chunk := "".join(window).strip():
                yield chunk
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    if chunk := "".join(window).strip():
        yield chunk


def split(text: str, size: int, overlap: int, separators: tuple = SEPARATORS) -> Iterator[str]:
    at = next(i for i, s in enumerate(separators) if s in text)
    good: list[str] = []
    for piece in cut(text, separators[at]):
        if len(piece) < size:
            good.append(piece)
            continue
        yield from merged(good, size, overlap)
        good = []
        if at + 1 < len(separators):
            yield from split(piece, size, overlap, separators[at + 1 :])
        else:
            yield piece
    yield from merged(good, size, overlap)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = DEFAULTS.CHUNK_SIZE, overlap: int = DEFAULTS.CHUNK_OVERLAP) -> DataFrame:
    """(key, text) -> (key, seq from 0, content); a null or blank text has no chunks."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, seqs, contents, held = [], [], [], 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for j, chunk in enumerate(split(t, size, overlap) if t else ()):
                    keys.append(k)
                    seqs.append(j)
                    contents.append(chunk)
                    held += len(chunk)
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(seqs, pa.int32()), pa.array(contents, pa.string())], names=[key, "seq", "content"])
                    keys, seqs, contents, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(seqs, pa.int32()), pa.array(contents, pa.string())], names=[key, "seq", "content"])

    return docs.select(key, F.col(text)).mapInArrow(run, f"{key} {kind}, seq int, content string")
