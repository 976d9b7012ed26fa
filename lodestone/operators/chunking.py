"""Documents to overlapping chunks that end at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import ChunkConfig
from lodestone.functions.text import word_count
from lodestone.operators.keywords import frequent_terms

CHARACTERS = 1_000_000
"""Chunks of about so many characters leave a worker at once."""


def _after_space(text: str, at: int) -> int:
    """The largest position up to `at` that white space precedes; 0 if none does."""
    while at > 0 and not text[at - 1].isspace():
        at -= 1
    return at


def _cut(text: str, start: int, end: int, separators: tuple[str, ...]) -> int:
    """Where a full window ends: behind the last of the best separator that lies past its first quarter, else at a word."""
    least = start + (end - start) // 4
    for separator in filter(None, separators):
        found = text.rfind(separator, start, end)
        if found >= 0 and found + len(separator) > least:
            return found + len(separator)
    word = _after_space(text, end)
    return word if word > start else end


def spans(text: str | None, config: ChunkConfig = ChunkConfig()) -> list[tuple[str, int, int]]:
    """(content, start, end) of each chunk; offsets count code points and end is exclusive. Content is not trimmed."""
    out: list[tuple[str, int, int]] = []
    start, total = 0, len(text or "")
    while start < total:
        end = min(start + config.size, total)
        last = end == total
        if not last:
            end = _cut(text, start, end, config.separators)
        piece = text[start:end]
        if len(piece.strip()) >= config.shortest or (last and not out):
            out.append((piece, start, end))
        if last:
            break
        back = _after_space(text, max(0, end - config.overlap))
        start = back if back > start else end
    return out


def chunk(documents: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of documents(doc_ord, doc_id, content, ...).

    chunk_id, doc_id, content, start_offset, end_offset, metadata and chunk_ord
    (a struct: document order, then position). A null or empty document has none.
    """

    most = CHARACTERS
    place = documents.schema["doc_ord"].dataType.simpleString()
    key = documents.schema["doc_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows + 1):
                if held and (i == batch.num_rows or size >= most):
                    at = pa.array([h[0] for h in held])
                    columns = [pa.array([h[j] for h in held], kind) for j, kind in ((1, pa.int32()), (2, pa.string()), (3, pa.int32()), (4, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_ord").take(at), batch.column("doc_id").take(at), *columns], names=["doc_ord", "doc_id", "index", "content", "start_offset", "end_offset"])
                    held, size = [], 0
                if i < batch.num_rows:
                    found = spans(batch.column("content")[i].as_py(), config)
                    held += [(i, k, *span) for k, span in enumerate(found)]
                    size += sum(len(c) for c, _, _ in found)

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return pd.Series([frequent_terms(t, config.keywords) for t in texts])

    # keywords are columns of their own, so that who doesn't ask for them doesn't count them
    placed = documents.select("doc_ord", "doc_id", F.col("content").cast("string").alias("content")).mapInArrow(split, f"doc_ord {place}, doc_id {key}, index int, content string, start_offset int, end_offset int")
    rows = placed.select(
        F.struct("doc_ord", "index").alias("chunk_ord"),
        F.concat_ws("_", "doc_id", F.col("index").cast("string")).alias("chunk_id"),
        "doc_id",
        "content",
        "start_offset",
        "end_offset",
        terms("content").alias("keywords"),
        "index",
    )
    extra = F.create_map().cast("map<string,string>")
    metadata = F.struct(F.col("index").alias("index"), word_count(F.col("content")).alias("word_count"), F.col("keywords").alias("keywords"), extra.alias("extra"))
    return rows.withColumn("metadata", metadata).drop("index", "keywords")
