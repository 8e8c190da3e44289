"""Records of text files that cannot be cut at line breaks, read by many tasks for each file.

Spark reads the file as segments: pieces between a separator byte, by byte ranges ("blocks").  Whether a
separator ends a record depends on what stands before it: inside quotes it does not, and in a JSON
document only one at the right bracket depth does.  Each segment is a small transition of that state.
A block sums up its segments for either state of the quotes at its start (the state after it, and at
which depth how many separators lie); a prefix scan over the few blocks of a file tells the state and
the record number each block really starts with.  Then every block puts together its own records, and
only the records that cross blocks meet in a shuffle, by their number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = "file string, block long, odd boolean, depth array<long>, places array<map<long, long>>"
_START = "file string, block long, inside boolean, depth long, first long, ends_inside boolean"


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _segments(spark: SparkSession, paths: str | Sequence[str], separator: str) -> DataFrame:
    return spark.read.text(paths, lineSep=separator).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def _runs(keys: list) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    begin = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[begin]:
            yield begin, i
            begin = i


def _block_keys(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: its transition from either state of the quotes."""
    at, odd, depth, places = None, False, [0, 0], [{}, {}]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "file": [at[0]], "block": [at[1]], "odd": [odd], "depth": [depth],
                "places": pa.array([[list(p.items()) for p in places]], pa.list_(pa.map_(pa.int64(), pa.int64()))),
            }
        )

    for batch in batches:
        keys = _block_keys(batch)
        quotes = batch.column("quotes").to_numpy(zero_copy_only=False)
        deltas = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("out", "in")]
        for a, b in _runs(keys):
            if keys[a] != at:
                if at is not None:
                    yield row()
                at, odd, depth, places = keys[a], False, [0, 0], [{}, {}]
            turned = np.cumsum(quotes[a:b]) % 2 == 1
            before = np.append(False, turned[:-1])
            for start in (0, 1):
                inside = before ^ odd ^ bool(start)
                level = depth[start] + np.cumsum(np.where(inside, deltas[1][a:b], deltas[0][a:b]))
                ends = ~(turned ^ odd ^ bool(start))
                for place, n in zip(*np.unique(level[ends], return_counts=True)):
                    places[start][int(place)] = places[start].get(int(place), 0) + int(n)
                depth[start] = int(level[-1])
            odd = bool(odd ^ turned[-1])
    if at is not None:
        yield row()


def _starts(target: int):
    """State and record number at the start of each block of one file."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows, inside, depth, first = [], False, 0, 0
        for b in frame.sort_values("block").itertuples():
            rows.append((b.file, b.block, inside, depth, first))
            k = int(inside)
            first += dict(b.places[k]).get(target - depth, 0)
            depth += int(b.depth[k])
            inside ^= bool(b.odd)
        made = pd.DataFrame(rows, columns=["file", "block", "inside", "depth", "first"])
        return made.assign(ends_inside=inside)

    return run


def _put_together(separator: str, target: int):
    """Records of a block; `open` marks pieces of records that other blocks hold parts of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, depth, number, held, whole = None, False, 0, 0, [], True
        out: list[tuple] = []

        def flush(closed: bool) -> None:
            nonlocal held, whole
            out.append((at[0], number, separator.join(held), at[1], not (whole and closed), closed))
            held, whole = [], True

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 6
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
            names = ["file", "number", "record", "block", "open", "closed"]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            keys = _block_keys(batch)
            values = batch.column("value").to_pylist()
            quotes = batch.column("quotes").to_numpy(zero_copy_only=False)
            deltas = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("out", "in")]
            states = [batch.column(c).to_pylist() for c in ("inside", "depth", "first")]
            for a, b in _runs(keys):
                if keys[a] != at:
                    if held:
                        flush(False)
                    at, inside, depth, number = keys[a], *(s[a] for s in states)
                    # the first record of a block may have begun before it; that of a file did not
                    whole = at[1] == 0
                after = (np.cumsum(quotes[a:b]) % 2 == 1) ^ inside
                before = np.append(inside, after[:-1])
                level = depth + np.cumsum(np.where(before, deltas[1][a:b], deltas[0][a:b]))
                done = np.flatnonzero(~after & (level == target)).tolist()
                begin = a
                for k in done:
                    held += values[begin : a + k + 1]
                    flush(True)
                    number += 1
                    begin = a + k + 1
                held += values[begin:b]
                inside, depth = bool(after[-1]), int(level[-1])
            yield made()
        if held:
            flush(False)
        yield made()

    return run


def _records(segments: DataFrame, separator: str, target: int) -> DataFrame:
    """(file, number, record, closed) of segments with `quotes` and bracket changes `out` and `in`."""
    numbers = segments.select("file", "block", "quotes", "out", "in")
    blocks = numbers.mapInArrow(_sum_up, _BLOCK)
    # one row for each byte range that the driver has listed for the scan
    starts = blocks.groupBy("file").applyInPandas(_starts(target), _START)
    known = segments.join(F.broadcast(starts), ["file", "block"])
    known = known.where(
        ~F.col("ends_inside") | F.raise_error(F.concat(F.lit("quotes are not closed in "), F.col("file"))).isNotNull()
    )
    schema = "file string, number long, record string, block long, open boolean, closed boolean"
    pieces = known.select("value", "file", "block", "quotes", "out", "in", "inside", "depth", "first").mapInArrow(
        _put_together(separator, target), schema
    )
    parts = F.array_sort(F.collect_list(F.struct("block", "record")))
    crossing = (
        pieces.where("open").groupBy("file", "number")
        .agg(F.array_join(F.transform(parts, lambda p: p["record"]), separator).alias("record"), F.max("closed").alias("closed"))
    )
    return pieces.where("not open").select("file", "number", "record", "closed").unionByName(crossing)


def csv_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, number, record): records of CSV files whose cells may hold line breaks inside quotes.

    Quotes are doubled inside quoted cells, as `write_csv` does, and stand nowhere else; a file whose
    quotes do not close is an error.  Numbers count from 0, the header included.
    """
    lines = _segments(spark, paths, "\n")
    none = F.lit(0)
    segments = lines.select("*", _count(F.col("value"), '"').alias("quotes"), none.alias("out"), none.alias("in"))
    return _records(segments, "\n", 0).drop("closed")


def read_csv_ranges(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Like Spark's own reading of multi-line CSV with a header, every column as text, but by byte ranges."""
    names = spark.read.csv(paths, header=True, multiLine=True, escape='"', inferSchema=False).columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = csv_records(spark, paths).where("number > 0 and rtrim('\r', record) <> ''")
    cells = F.from_csv("record", schema, {"escape": '"', "multiLine": "true"})
    return rows.select(cells.alias("_cells")).select("_cells.*")


def json_members(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, member): each top-level member `"key": value` of files that hold one JSON object, in any layout.

    A file is cut at its commas; those outside strings, inside the outer brackets only, part members.
    A member is one row.
    """
    text = _segments(spark, paths, ",")
    # an escape never spans a comma
    plain = F.regexp_replace("value", r"\\.", "")
    quotes = _count(plain, '"')

    def change(rest: Column) -> Column:
        bare = F.regexp_replace(rest, '"[^"]*("|$)', "")
        ups, downs = (F.regexp_replace(bare, f"[^{c}]", "") for c in (r"\[{", r"\]}"))
        return F.length(ups) - F.length(downs)

    inside = F.when(quotes > 0, change(F.regexp_replace(plain, '^[^"]*"', ""))).otherwise(F.lit(0))
    segments = text.select("*", quotes.alias("quotes"), change(plain).alias("out"), inside.alias("in"))
    rows = _records(segments, ",", 1)
    opened = F.when(F.col("number") == 0, F.regexp_replace("record", r"^[\s\x{FEFF}]*\{", "")).otherwise(F.col("record"))
    member = F.when(F.col("closed"), opened).otherwise(F.regexp_replace(opened, r"\}\s*$", ""))
    return rows.select("file", F.trim(member).alias("member")).where(F.regexp_replace("member", r"\s", "") != "")
