"""Texts cut into chunks of lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET_LINES, OVERLAP, SLACK = 50, 5, 10
CHUNK = "chunk_index int, total_chunks int, start_line int, end_line int, content string"
_HEADING = re.compile(r"#{1,6} ")


def fixed_windows(df: DataFrame, text: str = "text", target: int = TARGET_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Windows of `target` lines that overlap, over each text as one block; JVM only.

    Up to target + 10 lines make one chunk. Adds chunk_index, start_line, end_line and content in
    place of the text and of columns of these names. Null and empty texts give one empty chunk of
    line 1.
    """
    kept = [c for c in df.columns if c not in (text, "chunk_index", "start_line", "end_line", "content")]
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n\z", "")
    step = target - overlap
    lined = df.withColumn("__lines", F.split(body, "\n")).withColumn("__n", F.size("__lines"))
    starts = F.when(F.col("__n") <= target + SLACK, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(F.col("__n") - 1, F.lit(0)), F.lit(step)), lambda b: (b == 0) | (b + overlap < F.col("__n"))))
    cut = lined.select(*[F.col(f"`{c}`") for c in kept], "__lines", "__n", F.posexplode(starts).alias("chunk_index", "__start"))
    end = F.when(F.col("__n") <= target + SLACK, F.col("__n")).otherwise(F.least(F.col("__start") + target, F.col("__n")))
    return cut.select(*[F.col(f"`{c}`") for c in kept], "chunk_index", (F.col("__start") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("__lines", F.col("__start") + 1, end - F.col("__start")), "\n").alias("content"))


def segments(lines: list[str], markdown: bool) -> list[int]:
    """Where a text may be cut: before headings, or before what follows a blank line."""
    cuts = [0]
    for i in range(1, len(lines)):
        if _HEADING.match(lines[i]) if markdown else lines[i].strip() and not lines[i - 1].strip():
            cuts.append(i)
    return [*cuts, len(lines)]


def windows(cuts: list[int], target: int = TARGET_LINES, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Line ranges (from, to) over cut places: segments gathered up to `target` lines, long ones slid over."""
    start, k = 0, 1
    while k < len(cuts):
        if cuts[k] - start > target + SLACK:
            while True:
                yield start, min(start + target, cuts[k])
                if start + target >= cuts[k]:
                    break
                start += target - overlap
        else:
            while k + 1 < len(cuts) and cuts[k + 1] - start <= target:
                k += 1
            yield start, cuts[k]
        start = cuts[k]
        k += 1


def chunk_text(text: str | None, markdown: bool = False, target: int = TARGET_LINES, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(first line, last line, content) of each chunk, lines counted from 1."""
    lines = (text or "").splitlines(keepends=True)
    if not lines:
        return [(1, 1, "")]
    return [(a + 1, b, "".join(lines[a:b])) for a, b in windows(segments(lines, markdown), target, overlap)]


def chunks(df: DataFrame, text: str = "text", markdown: str | None = None, target: int = TARGET_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of each text along paragraphs, or headings where column `markdown` is true.

    Adds the columns of CHUNK in place of the text and of columns of these names. Null and empty texts give one empty chunk.
    """
    made = [x.split()[0] for x in CHUNK.split(", ")]
    keep = [c for c in df.columns if c not in (text, markdown, *made)]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"), (F.col(markdown) if markdown else F.lit(False)).alias("__md"))
    schema = ", ".join([f"`{c}` {t}" for c, t in source.dtypes[: len(keep)]] + [CHUNK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = [(i, k, len(found), *c) for i, (t, md) in enumerate(zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist(), strict=True)) for found in [chunk_text(t, bool(md), target, overlap)] for k, c in enumerate(found)]
                at, k, n, a, b, body = zip(*rows, strict=True) if rows else ((),) * 6
                columns = [c.take(pa.array(at, pa.int64())) for c in part.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int32()) for x in (k, n, a, b)), pa.array(body, pa.string())], names=[*keep, "chunk_index", "total_chunks", "start_line", "end_line", "content"])

    return source.mapInArrow(run, schema)
