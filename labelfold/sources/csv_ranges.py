"""Parallel scan of large CSV files whose quoted fields may hold line breaks (SRC-1).

Spark cuts a file into byte ranges of whole lines.  Whether a line starts inside a quoted field follows
from the number of quotes before it: each range counts its own, prefix sums over the ranges of a file give
the state at each range's start, and records are then cut in parallel.  A line that is a record by itself
never moves; only the lines of records with line breaks are shuffled, each record to a place of its own.

This is exact where quotes stand only round whole fields (doubled inside), as RFC 4180 says.  A quote
inside an unquoted field, or a file that ends inside a quoted one, would make the count wrong: both raise.
Lines end with LF or CR LF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LINES = "file string, block long, line long, value string, before int, after int, open0 long, open1 long"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number each range's lines and count quotes: parity before and after a line, and, for a range that starts
    outside (0) or inside (1) of quotes, the last line up to here that opened a record of several lines (-1: none)."""
    where, line, parity, opened = None, 0, 0, [-1, -1]
    for batch in batches:
        files, blocks = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        names = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(names) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(blocks)]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            here = (files[a].as_py(), int(blocks[a]))
            if here != where:
                where, line, parity, opened = here, 0, 0, [-1, -1]
            after = (parity + np.cumsum(pc.count_substring(part.column(2), '"').to_numpy(zero_copy_only=False))) % 2
            before = np.concatenate([[parity], after[:-1]])
            numbers = np.arange(line, line + b - a)
            opens = []
            for s in (0, 1):
                opening = ((before + s) % 2 == 0) & ((after + s) % 2 == 1)
                opens.append(np.maximum.accumulate(np.where(opening, numbers, opened[s])))
                opened[s] = int(opens[s][-1])
            line, parity = line + b - a, int(after[-1])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(blocks[a:b], pa.int64()), pa.array(numbers, pa.int64()), part.column(2),
                 pa.array(before, pa.int32()), pa.array(after, pa.int32()), pa.array(opens[0], pa.int64()), pa.array(opens[1], pa.int64())],
                ["file", "block", "line", "value", "before", "after", "open0", "open1"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, record): the text of every record, and where it starts; blank lines are no records."""
    raw = spark.read.text(path, lineSep="\n").select("_metadata.file_path", F.col("_metadata.file_block_start"), "value")
    lines = raw.mapInArrow(_number, _LINES)
    last = F.max_by(F.struct("after", "open0", "open1"), "line")
    ranges = lines.groupBy("file", "block").agg(last.alias("z")).select("file", "block", "z.*")
    # one row a range: a file's group is its size over spark.sql.files.maxPartitionBytes
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = ranges.withColumn("start", (F.coalesce(F.sum("after").over(w), F.lit(0)) % 2).cast("int"))
    own = F.when(F.col("start") == 0, F.col("open0")).otherwise(F.col("open1"))
    held = F.when(own >= 0, F.struct(F.col("block").alias("b"), own.alias("l")))
    states = states.withColumn("_held", held).select(
        "file", "block", "start", F.last("_held", ignorenulls=True).over(w).alias("carried"))
    x = lines.join(states, ["file", "block"])
    inside, stays = (F.col("before") + F.col("start")) % 2 == 1, (F.col("after") + F.col("start")) % 2 == 1
    opened = F.when(F.col("start") == 0, F.col("open0")).otherwise(F.col("open1"))
    begin = (F.when(~inside, F.struct(F.col("block").alias("b"), F.col("line").alias("l")))
             .when(opened >= 0, F.struct(F.col("block").alias("b"), opened.alias("l"))).otherwise(F.col("carried")))
    x = x.select("file", "block", "line", "value", begin.alias("begin"), (~inside & ~stays).alias("alone"), stays.alias("stays"))
    # by way of ``alone`` a later check of records can't be pushed down to lines that are parts of one
    single = x.filter("alone").select("file", "block", "line", F.when(F.col("alone"), F.col("value")).alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value", "stays")))
    several = x.filter(~F.col("alone")).groupBy("file", "begin").agg(parts.alias("p"))
    closed = F.when(F.element_at("p", -1)["stays"], F.raise_error(F.concat(F.lit("the file ends inside a quoted field: "), F.col("file"))))
    several = several.filter(closed.isNull()).select(
        "file", "begin.b", "begin.l", F.array_join(F.transform("p", lambda v: v["value"]), "\n"))
    out = single.union(several).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return out.filter(F.col("record") != "")


def rejected_bare_quotes(found: DataFrame) -> DataFrame:
    """Raise on a record with a quote inside of an unquoted field."""
    mark = "\x01"
    shape = F.regexp_replace(F.regexp_replace("record", mark, "x"), '"[^"]*+"', mark)
    bare = shape.rlike(f"[^,{mark}]{mark}|{mark}[^,{mark}]")
    return found.filter(F.when(bare, F.raise_error(F.concat(
        F.lit("a quote inside an unquoted CSV field, use the multiLine scan; the record starts with "), F.substring("record", 1, 80)))).isNull())


def parsed(spark: SparkSession, path: str, schema, corrupt: str) -> DataFrame:
    """The fields of every record but each file's first (its header)."""
    found = rejected_bare_quotes(records(spark, path).filter("NOT (block = 0 AND line = 0)"))
    options = {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "columnNameOfCorruptRecord": corrupt}
    ddl = ", ".join(f"`{f.name}` string" for f in schema.fields)
    return found.select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
