"""Helpers that the corpus operators share: stored tables, batch-wise text functions, row hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cosmotab.sources.shared import stored as written  # noqa: F401

SLICE_BYTES = 8 << 20


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 2 by 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def utf8_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in one array, and the n + 1 offsets of the texts in it; null counts as empty."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, sizes: np.ndarray, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `budget` bytes each, one row at least."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + budget, side="right")))
        yield batch.slice(i, j - i)
        i = j


def map_texts(
    docs: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[pa.Array], list]],
    fields: str,
    carry: list[str] | None = None,
    budget: int = SLICE_BYTES,
) -> DataFrame:
    """One row per row of docs: struct column `row` with the carried columns, then `fields` computed from the text.

    make() runs once a task and returns the function from an array of texts (null: empty) to one array per field. No
    shuffle; a task holds one Arrow batch and `budget` bytes of text under work. The struct keeps any name of a carried
    column apart from the fields' names.
    """
    carry = docs.columns if carry is None else carry
    inside = carry.index(text_col) if text_col in carry else None
    row = F.struct(*[docs[c] for c in carry]).alias("row")
    source = docs.select(row) if inside is not None else docs.select(row, docs[text_col].cast("string").alias("text"))
    out = T.StructType([source.schema["row"], *T._parse_datatype_string(fields).fields])
    kinds = [f.dataType for f in out.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        work = None
        for batch in batches:
            if not batch.num_rows:
                continue
            work = work or make()
            texts = batch.column(0).flatten()[inside] if inside is not None else batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for part in slices(batch, sizes, budget):
                rows = part.column(0)
                texts = rows.flatten()[inside] if inside is not None else part.column(1)
                made = [x if isinstance(x, pa.Array) else pa.array(x, to_arrow_type(k)) for x, k in zip(work(pc.fill_null(texts, "")), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([rows, *made], names=out.names)

    return source.mapInArrow(run, out)


def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_of(offsets: np.ndarray) -> np.ndarray:
    """For each byte of a batch, the index of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
