"""Quoted CSV read by many tasks, and written so that it reads back as it was.

A field may hold line breaks between its quotes, so a line of the file is not a record
and Spark's own reader takes such a file whole in one task (``multiLine``). Here every
split of a file is read as lines. A line leaves the reader inside or outside quotes,
depending on where it starts; a first pass finds for each split both outcomes, with the
number of records begun, the outcomes of a file's splits are chained in order, and a
second pass, knowing where its split starts, cuts the records. Only a record that lies
in several splits is put together by a shuffle.

A quote opens a field only as its first character and is literal elsewhere; inside
quotes it is doubled; text between a closing quote and the next comma is kept literally.

``\\N`` stands for NULL. A text of backslashes and one N gets one more backslash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.session import scratch_path

NULL = r"\N"
_ESCAPED = r"^\\+N$"
#: Most splits whose states are sent to every task; with more, lines go to their split's state.
BROADCAST_SPLITS = 200_000
#: Column of the names of the columns a record has nothing for.
ABSENT = "_absent"
#: Never in a file: what the parser returns for a field without any text.
_MISSING = "\u0001\u0002missing"


def ends_inside(line: str, inside: bool) -> bool:
    """Does a line that starts inside (outside) quotes end inside them?"""
    at, n = 0, len(line)
    while True:
        if not inside:
            if at < n and line[at] == '"':
                at += 1
            else:
                at = line.find(",", at) + 1
                if at == 0 or '"' not in line[at:]:
                    return False
                continue
        while True:  # inside: the closing quote
            at = line.find('"', at)
            if at < 0:
                return True
            if at + 1 < n and line[at + 1] == '"':
                at += 2
                continue
            break
        inside = False
        at = line.find(",", at) + 1
        if at == 0:
            return False


def _runs(files: list, starts: list):
    """Ranges of neighbouring rows of one split."""
    lo = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or starts[i] != starts[lo] or files[i] != files[lo]:
            yield lo, i
            lo = i


def _outcomes(batches):
    """Task: per split, for a start outside (0) and inside (1) quotes: state at its end, records begun."""
    now, state, begun = None, [0, 1], [0, 0]

    def row():
        return pa.RecordBatch.from_pydict(
            {"file": [now[0]], "start": pa.array([now[1]], pa.int64()), "to0": pa.array([state[0]], pa.int32()),
             "to1": pa.array([state[1]], pa.int32()), "n0": pa.array([begun[0]], pa.int64()), "n1": pa.array([begun[1]], pa.int64())})

    for b in batches:
        lines, files, starts = (b.column(c).to_pylist() for c in ("value", "file", "start"))
        for lo, hi in _runs(files, starts):
            if now != (files[lo], starts[lo]):
                if now:
                    yield row()
                now, state, begun = (files[lo], starts[lo]), [0, 1], [0, 0]
            for i in range(lo, hi):
                line = lines[i]
                for s in (0, 1):
                    begun[s] += not state[s]
                if '"' in line:
                    outside, inside = ends_inside(line, False), ends_inside(line, True)
                    state = [int(inside if x else outside) for x in state]
    if now:
        yield row()


def _chain(splits: pa.Table) -> pa.Table:
    """One file: the state each split starts in and the records begun before it."""
    state, records = 0, 0
    rows = sorted(splits.to_pylist(), key=lambda r: r["start"])
    out = []
    for r in rows:
        out.append((r["file"], r["start"], state, records))
        records += r["n1"] if state else r["n0"]
        state = r["to1"] if state else r["to0"]
    names = ("of_file", "of_start", "inside", "before")
    types = (pa.string(), pa.int64(), pa.int32(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _cut(batches):
    """Task: the records of its splits; a record shared with another split comes in pieces."""
    schema = pa.schema([("file", pa.string()), ("record_no", pa.int64()), ("start", pa.int64()), ("whole", pa.bool_()),
                        ("record", pa.string())])
    now, held, number, begun_here, inside = None, [], 0, True, False
    out = []

    def close(complete: bool):
        nonlocal held
        if held:
            out.append((now[0], number, now[1], begun_here and complete, "\n".join(held)))
            held = []

    for b in batches:
        lines, files, starts, insides, befores = (b.column(c).to_pylist() for c in ("value", "file", "start", "inside", "before"))
        for lo, hi in _runs(files, starts):
            if now != (files[lo], starts[lo]):
                close(not inside)
                now, inside = (files[lo], starts[lo]), bool(insides[lo])
                number, begun_here = befores[lo] - 1, False
            for i in range(lo, hi):
                if not inside:
                    close(True)
                    number, begun_here = number + 1, True
                held.append(lines[i])
                if '"' in lines[i]:
                    inside = ends_inside(lines[i], inside)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    close(not inside)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def read_records(spark: SparkSession, paths) -> DataFrame:
    """``file``, ``record_no`` (from 0 in its file), ``record``: the CSV records, header included."""
    lines = (spark.read.option("lineSep", "\n").text(paths)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))
    splits = lines.mapInArrow(_outcomes, "file string, start long, to0 int, to1 int, n0 long, n1 long")
    chained = splits.groupBy("file").applyInArrow(_chain, "of_file string, of_start long, inside int, before long")
    path = scratch_path(spark, "csv-splits")
    chained.write.parquet(path)  # one row per split
    chained = spark.read.schema(chained.schema).parquet(path)
    of = (F.col("file") == F.col("of_file")) & (F.col("start") == F.col("of_start"))
    if chained.count() <= BROADCAST_SPLITS:
        placed = lines.join(F.broadcast(chained), of)
    else:
        placed = (lines.withColumn("pos", F.monotonically_increasing_id()).join(chained, of)
                  .repartition("file", "start").sortWithinPartitions("file", "start", "pos"))
    pieces = placed.select("value", "file", "start", "inside", "before").mapInArrow(
        _cut, "file string, record_no long, start long, whole boolean, record string")
    whole = pieces.where("whole").select("file", "record_no", "record")
    shared = (pieces.where("not whole").groupBy("file", "record_no")
              .agg(F.array_sort(F.collect_list(F.struct("start", "record"))).alias("p"))
              .select("file", "record_no", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")))
    return whole.unionByName(shared)


def read_csv(spark: SparkSession, paths, columns: list[str], corrupt: str) -> DataFrame:
    """All columns as strings, without each file's first line if that is the header.

    A record with too few or too many fields is in ``corrupt``. A field without text or quotes
    is NULL and its column is named in the array ``_absent``; ``\\N`` is NULL; a quoted empty field
    is an empty text. A U+0000 that begins a record's last field is lost (a limit of the parser).
    """
    schema = ", ".join(f"`{c}` STRING" for c in [*columns, corrupt])
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "multiLine": "true",
               "nullValue": _MISSING, "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "maxCharsPerColumn": "-1"}
    records = read_records(spark, paths).where(F.col("record") != "")
    line = F.regexp_replace("record", r"\r\z", "")  # the carriage return of a CRLF line end
    # generated, so that a record is parsed once, not again for every column and filter that names it
    rows = records.select("record_no", F.inline(F.array(F.from_csv(line, schema, options))))
    header = F.array(*columns) == F.array(*[F.lit(c) for c in columns])
    rows = rows.where((F.col("record_no") > 0) | ~F.coalesce(header, F.lit(False)))
    absent = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return rows.select(*[_unescaped(F.col(c)).alias(c) for c in columns], corrupt,
                       absent.alias(ABSENT))


def _unescaped(c: Column) -> Column:
    return F.when(c == F.lit(NULL), F.lit(None)).when(c.rlike(_ESCAPED), F.substr(c, F.lit(2))).otherwise(c)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header in every part file; every field quoted."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "string":
            c = F.when(c.rlike(_ESCAPED), F.concat(F.lit("\\"), c)).otherwise(c)
        out.append(F.coalesce(c.cast("string"), F.lit(NULL)).alias(f.name))
    (df.select(*out).write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"')
     .option("emptyValue", "").option("lineSep", "\n")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
