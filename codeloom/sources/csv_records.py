"""CSV files whose quoted cells hold line ends, read in splits.

Spark reads such a file in one task, because a split cannot know whether it begins inside a quoted cell. Here every split is first scanned
for both cases; the ends of the scans, taken in the order of the file, tell how each split really begins. Then each split cuts its own
records. A record that goes on in the next split is put together from its parts, of which a split has two at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Records over a split's end are sent to the tasks up to so many bytes; beyond, all records are sorted by their place instead.
MAX_SENT_BYTES = 64 * 1024 * 1024

_KEYS = ["file", "block"]
_FRAGMENTS = "file string, block bigint, seq int, text string, opens boolean, closes boolean"


def ends_quoted(line: str, quoted: bool, sep: str) -> bool:
    """Whether a line leaves a quoted cell open. A quote opens a cell only at its start; a doubled one inside it is a character."""
    at = 0
    while True:
        if quoted:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            quoted = False
            at = line.find(sep, at + 1)
        elif line.startswith('"', at):
            quoted, at = True, at + 1
            continue
        else:
            at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Runs of lines of one block, in order; a block may come in several runs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = pa.StructArray.from_arrays([batch.column(k) for k in _KEYS], _KEYS)
        runs = pc.run_end_encode(batch.column("block"))
        files = pc.run_end_encode(batch.column("file"))
        ends = sorted({*runs.run_ends.to_pylist(), *files.run_ends.to_pylist()})
        for low, high in zip([0, *ends[:-1]], ends, strict=True):
            key = keys[low].as_py()
            yield (key["file"], key["block"]), batch.column("value").slice(low, high - low)


def _scan(sep: str):
    """For each block, how it ends if it begins outside of a quoted cell, and if it begins inside of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], tuple[bool, bool]] = {}
        for key, lines in _blocks(batches):
            outside, inside = found.get(key, (False, True))
            for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
                outside, inside = ends_quoted(line, outside, sep), ends_quoted(line, inside, sep)
            found[key] = (outside, inside)
        rows = [(*key, *ends) for key, ends in found.items()]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*_KEYS, "outside", "inside"])

    return run


def _fragments(sep: str, begin_quoted: set[tuple[str, int]], torn_only: bool):
    """Records, and parts of records that lie over the ends of a block, in the order of the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, quoted, opens, held = None, 0, False, True, []
        for found, lines in _blocks(batches):
            out: list[tuple] = []
            if found != key:
                if held:
                    out.append((*key, seq, "\n".join(held), opens, False))
                key, seq, quoted, held = found, 0, found in begin_quoted, []
                opens = not quoted
            for line in lines.to_pylist():
                quoted = ends_quoted(line, quoted, sep) if '"' in line else quoted
                held.append(line)
                if not quoted:
                    if not (torn_only and opens):
                        out.append((*key, seq, "\n".join(held), opens, True))
                    seq, opens, held = seq + 1, True, []
            if out:
                yield _as_batch(out)
        if held:
            yield _as_batch([(*key, seq, "\n".join(held), opens, False)])

    return run


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
    names = ["file", "block", "seq", "text", "opens", "closes"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _with_torn(fragments, whole: dict[tuple[str, int], str]):
    """The records that begin in a block, the last one in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fragments(batches):
            kept = batch.filter(batch.column("opens"))
            if not kept.num_rows:
                continue
            texts = kept.column("text")
            if not pc.all(kept.column("closes")).as_py():
                rows = kept.to_pylist()
                texts = pa.array([r["text"] if r["closes"] else whole[r["file"], r["block"]] for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("file", "block", "seq")), texts], names=["file", "block", "seq", "text"])

    return run


def csv_records(spark: SparkSession, path: str, sep: str = ",", max_sent_bytes: int = MAX_SENT_BYTES) -> DataFrame:
    """``(file, block, seq, text)``: every record of the files, in their order, without its line end. Headers are records too."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # One row of two truth values for each split of the files.
    scanned = sorted(lines.mapInArrow(_scan(sep), "file string, block bigint, outside boolean, inside boolean").collect())
    begin_quoted, state, file = set(), False, None
    for row in scanned:
        state = state if row.file == file else False
        file = row.file
        if state:
            begin_quoted.add((row.file, row.block))
        state = row.inside if state else row.outside
    torn = lines.mapInArrow(_fragments(sep, begin_quoted, True), _FRAGMENTS)
    number = F.sum(F.col("opens").cast("int")).over(W.partitionBy("file").orderBy("block", "seq"))
    parts = F.array_sort(F.collect_list(F.struct("block", "seq", "text")))
    torn = torn.withColumn("number", number).groupBy("file", "number").agg(parts.alias("parts")).select(
        "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["seq"].alias("seq"), F.array_join("parts.text", "\n").alias("text")
    )
    # Without a split that begins or a file that ends inside a cell there is nothing to put together.
    any_torn = bool(begin_quoted) or any(r.outside for r in scanned)
    size = torn.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] if any_torn else 0
    fragments = _fragments(sep, begin_quoted, False)
    schema = "file string, block bigint, seq int, text string"
    if size <= max_sent_bytes:
        whole = {(r.file, r.block): r.text for r in torn.collect()} if any_torn else {}
        records = lines.mapInArrow(_with_torn(fragments, whole), schema)
    else:
        plain = lines.mapInArrow(fragments, _FRAGMENTS).where("opens AND closes").select("file", "block", "seq", "text")
        records = plain.unionByName(torn).sort("file", "block", "seq")
    return records.withColumn("text", F.regexp_replace("text", "\r$", ""))


def read_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """The cells of the files as strings under the given names; the first record of each file is its header."""
    records = csv_records(spark, path, sep).where(~((F.col("block") == 0) & (F.col("seq") == 0)) & (F.col("text") != ""))
    schema = ", ".join(f"c{n} string" for n in range(len(columns)))
    cells = F.from_csv("text", schema, {"sep": sep, "escape": '"', "multiLine": "true"})
    return records.select(cells.alias("cells")).select("cells.*").toDF(*columns)
