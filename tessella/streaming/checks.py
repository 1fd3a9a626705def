"""Validation of marker cells and of quotes as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.markers import validate
from tessella.operators.quotes import PART_BYTES, fits, found_in, with_segments


def invalid_cells(stream: DataFrame) -> DataFrame:
    """Cells of a stream (with ``value``) that are invalid, with their error, as a stream; stateless. Each cell is judged by itself: with many cells of few values, use :func:`find_invalid_cells`."""
    return validate(stream).where("error is not null")


def find_invalid_cells(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Cells of a stream (with ``value``) that are invalid, with their error, to ``path``, a folder for each micro-batch, which a re-run batch replaces.

    Each micro-batch is judged as a table is, each of its values once. No state is kept.
    """
    return _by_batch(stream, invalid_cells, path, checkpoint)


def _by_batch(stream: DataFrame, found: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """What is found in each micro-batch, a table, to its folder."""

    def write(batch: DataFrame, number: int) -> None:
        found(batch).write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def found_quotes(stream: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Quotes of a stream that a table of prepared evidence holds, as a stream; stateless. All texts of a question meet in one task: with busy questions, use :func:`find_quotes`."""
    held = evidence.selectExpr(*[f"{k} AS __{k}" for k in keys], "nt AS __nt")
    quoted = with_segments(stream)
    condition = fits("__nt")
    for k in keys:
        condition = (quoted[k] == held[f"__{k}"]) & condition
    return quoted.join(held, condition, "left_semi")


def find_quotes(stream: DataFrame, evidence: DataFrame, keys: list[str], path: str, checkpoint: str, part_bytes: int = PART_BYTES) -> StreamingQuery:
    """Quotes of a stream that a table of prepared evidence holds, to ``path``, a folder for each micro-batch, which a re-run batch replaces.

    Each micro-batch is matched as a table is: a busy question's texts are dealt into parts, and
    each of the stream's rows comes once, in however many parts it is found. No state is kept.
    """

    def find(batch: DataFrame) -> DataFrame:
        quoted = with_segments(batch)
        return quoted.join(found_in(quoted, evidence, keys, part_bytes), [*keys, "pattern"], "left_semi").select(*batch.columns)

    return _by_batch(stream, find, path, checkpoint)
