"""Continuous ingestion of search responses.

:func:`append_stream` is the exact form: each micro-batch is deduplicated within
itself in order, joined against the cache and appended, so repeats of any age are
recognised and a re-run batch adds nothing; :func:`compact` folds the batches' small files
into parts that grow in number with the cache. :func:`deduplicated` keeps the keys seen as
state instead, which grows without bound because the cache never forgets; which of
several equal-keyed rows of one micro-batch it keeps is not defined.
:func:`deduplicated_within` bounds that state by a watermark: a repeat that comes later
than the delay appears again.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.snippets import KEY, RECORD, counted, first_of_each, flatten, fresh, items, keyed
from tessella.tables import read_or_empty

ORDER = ["round", "batch", "pos"]


def records(responses: DataFrame) -> DataFrame:
    """Records, with ``batch`` and ``pos``, of a stream or table of responses."""
    return flatten(items(responses), ("batch", "pos"))


#: One line of an input file: a search's context and the response, as JSON text or as JSON itself.
RESPONSES = "run_id string, qid string, round int, query string, source_seed string, followed string, batch long, response string, malformed string"


def response_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines that arrive as files in a folder; a line that is not of the form :data:`RESPONSES` is kept as ``malformed``."""
    return spark.readStream.schema(RESPONSES).option("columnNameOfCorruptRecord", "malformed").json(folder)


def _unreadable() -> Column:
    return F.col("malformed").isNotNull() | F.expr("try_parse_json(response)").isNull()


def readable(responses: DataFrame) -> DataFrame:
    """Responses whose line and payload are JSON; a payload of another shape is readable, and has no records."""
    return responses.where(~_unreadable()).drop("malformed")


def unreadable(responses: DataFrame) -> DataFrame:
    """``run_id, qid, payload`` of the others: the line, or the payload, that is not JSON."""
    return responses.where(_unreadable()).select("run_id", "qid", F.coalesce("malformed", "response").alias("payload"))


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB: keys seen may be more than an executor's memory holds."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def ingest_files(spark: SparkSession, folder: str, path: str) -> None:
    """All files that have come to ``folder`` since the last call: records, each key once, to ``path/records``, and what is no JSON to ``path/malformed``.

    Both are streams of their own, with checkpoints under ``path``, so that a restart goes on
    with the files and the keys that it has not seen.
    """
    arrived = response_stream(spark, folder)
    outputs = {"records": deduplicated(records(readable(arrived))), "malformed": unreadable(arrived)}
    with state_on_disk(spark):
        started = [
            x.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/state/{name}").trigger(availableNow=True).start()
            for name, x in outputs.items()
        ]
    for stream in started:
        stream.awaitTermination()


def deduplicated(stream: DataFrame) -> DataFrame:
    return keyed(stream).dropDuplicates(KEY).drop("start", "end")


def deduplicated_within(stream: DataFrame, arrival: str, delay: str) -> DataFrame:
    return keyed(stream.withWatermark(arrival, delay)).dropDuplicatesWithinWatermark(KEY).drop("start", "end")


#: Records of one part of a cache; what is written is put into the power of two of parts, by question, that makes them about so large.
PART_ROWS = 1_000_000
_PLACE = "parts int, part int"


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("run_id", "qid"), F.lit(parts)).cast("int")


def _parts(n: int, part_rows: int) -> int:
    return 1 << max(0, math.ceil(n / part_rows) - 1).bit_length()


def appender(path: str, schema: str, writer: str | Callable[[SparkSession], str], report: Callable[[int, dict[str, int]], None] | None = None, part_rows: int = PART_ROWS) -> Callable[[DataFrame, int], None]:
    """A batch function that appends the records that the cache at ``path`` does not have yet.

    ``report`` is given each batch's number and the counts of records ``offered`` and ``added``,
    which the batch's own jobs have counted.

    A batch is written under its writer and its own number, so that running it again after
    a failure replaces what it had written and nothing else; numbers start again with each
    writer, which is the stream's id (or a function that gives it).
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = writer if isinstance(writer, str) else writer(spark)
        rows, offered = counted(batch)
        first = first_of_each(rows, ORDER).persist()
        parts = _parts(first.count(), part_rows)
        compacted, batches = _tables(spark, path, schema)
        others = batches.where((F.col("writer") != own) | (F.col("batch_no") != number))
        known = of_questions(compacted, first).select(*RECORD).unionByName(of_questions(others, first).select(*RECORD))
        new, added = counted(fresh(first, known).select(*RECORD))
        placed = new.withColumns({"parts": F.lit(parts), "part": _part(parts)})
        placed.write.mode("overwrite").partitionBy("parts", "part").parquet(f"{path}/batches/writer={own}/batch_no={number}")
        first.unpersist()
        if report:
            report(number, {"offered": offered.get["n"], "added": added.get["n"]})

    return add


def of_questions(cache: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of ``cache`` in the parts that the questions of ``records`` are in: one set of part numbers for each number of parts that the files' folders name."""
    layouts = sorted({int(n) for file in cache.inputFiles() for n in re.findall(r"/parts=(\d+)/", file)})
    if not layouts:
        return cache.where("false")
    own = records.agg(*[F.collect_set(_part(n)).alias(str(n)) for n in layouts]).first()
    return cache.where(reduce(or_, [(F.col("parts") == n) & F.col("part").isin(own[str(n)]) for n in layouts]))


def _folded(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, f"{path}/compacted/folded", "file string, generation long", "parquet")


def _generation(spark: SparkSession, path: str) -> int:
    """The number of the last compaction that was completed; 0 before the first."""
    return _folded(spark, path).agg(F.max("generation")).first()[0] or 0


def _tables(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """What the last compaction has written, and the batches (with ``file``) that it has not folded in."""
    newest = read_or_empty(spark, f"{path}/compacted/records/generation={_generation(spark, path)}", f"{schema}, {_PLACE}", "parquet")
    batches = read_or_empty(spark, f"{path}/batches", f"{schema}, writer string, batch_no long, {_PLACE}", "parquet")
    file = F.col("_metadata.file_path") if batches.inputFiles() else F.lit("")
    return newest, batches.withColumn("file", file).join(_folded(spark, path).select("file"), "file", "left_anti")


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All records of a cache; none where nothing has been written. Reading writes nothing."""
    compacted, batches = _tables(spark, path, schema)
    return compacted.select(*RECORD).unionByName(batches.select(*RECORD))


def compact(spark: SparkSession, path: str, schema: str, part_rows: int = PART_ROWS) -> int:
    """Fold the batches' files into as many parts as the whole cache now fills; returns the number of files folded in.

    The list of those files is written last and makes the new generation the one that is read,
    so a compaction that fails changes nothing, and readers see each record once at any time.
    Files and generations that are no longer read are then removed (readers that have begun
    before are not waited for). To be called between streams, not while one appends. A batch that
    runs again later finds its records known. A part of a busy question is several files.
    """
    generation = _generation(spark, path) + 1
    compacted, batches = _tables(spark, path, schema)
    files = [r.file for r in batches.select("file").distinct().collect()]  # as many as were written since the last compaction
    if files:
        records = compacted.select(*RECORD).unionByName(batches.select(*RECORD))
        parts = _parts(records.count(), part_rows)
        placed = records.withColumns({"parts": F.lit(parts), "part": _part(parts)}).hint("rebalance", "part")
        placed.write.mode("overwrite").partitionBy("parts", "part").parquet(f"{path}/compacted/records/generation={generation}")
        spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.parquet(f"{path}/compacted/folded/generation={generation}")
    _remove(spark, path)
    return len(files)


def _remove(spark: SparkSession, path: str) -> None:
    """Remove what the last completed compaction has replaced; what an interrupted call has left is found again."""
    jvm, newest = spark._jvm, _generation(spark, path)
    fs_of = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration())
    for row in _folded(spark, path).where(F.col("generation") == newest).collect():
        file = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row.file))
        fs_of(file).delete(file, False)
    for kind in ("records", "folded"):
        pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/compacted/{kind}/generation=*")
        for found in fs_of(pattern).globStatus(pattern) or []:
            if int(found.getPath().getName().partition("=")[2]) < newest:
                fs_of(pattern).delete(found.getPath(), True)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps across restarts, from its checkpoint."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def append_stream(stream: DataFrame, path: str, checkpoint: str, schema: str, report: Callable[[int, dict[str, int]], None] | None = None) -> StreamingQuery:
    """Appends all that is available, exactly once, first writer first; streams with other checkpoints may append to the same cache in turn."""
    add = appender(path, schema, lambda spark: stream_id(spark, checkpoint), report)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
