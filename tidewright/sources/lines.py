"""Data sources of text lines: members of zip files, and log files that are followed byte by byte.

Files are found and opened by pyarrow's file systems, so a path may be a shared folder of any kind that these know.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes read at a time, and bytes of a log that one task reads at most (but for the end of its last line).
BLOCK, RANGE = 4 << 20, 64 << 20


def _files(path: str, ending: str) -> list[pa.fs.FileInfo]:
    """The files of a folder and those below it, or the file of that name, in order; none where nothing is there."""
    fs, place = pa.fs.FileSystem.from_uri(path)
    info = fs.get_file_info(place)
    if info.type == pa.fs.FileType.NotFound:
        return []
    found = [info] if info.type == pa.fs.FileType.File else fs.get_file_info(pa.fs.FileSelector(place, recursive=True))
    return sorted((f for f in found if f.type == pa.fs.FileType.File and f.path.endswith(ending)), key=lambda f: f.path)


def _text(lines: list[bytes]) -> pa.Array:
    return pa.array([x.rstrip(b"\r").decode("utf-8", "replace") for x in lines], pa.string())


class ZippedLines(DataSource):
    """file, member and line of the zip files at a path. A zip file is one task's, which unpacks it block by block."""

    @classmethod
    def name(cls) -> str:
        return "zipped_lines"

    def schema(self) -> str:
        return "file string, member string, line string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _ZipReader(self.options["path"])


class _ZipReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f.path) for f in _files(self.path, ".zip")] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.value) as raw, zipfile.ZipFile(raw) as packed:
            for member in packed.namelist():
                with packed.open(member) as text:
                    rest = b""
                    while block := text.read(BLOCK):
                        *lines, rest = (rest + block).split(b"\n")
                        yield self._batch(partition.value, member, lines)
                    yield self._batch(partition.value, member, [rest] if rest else [])

    def _batch(self, file: str, member: str, lines: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(lines), pa.string()), pa.array([member] * len(lines), pa.string()), _text(lines)], names=["file", "member", "line"])


class LogTail(DataSource):
    """file, at and line of the log files at a path (those that end in option `ending`, .log at first), as a stream. at is the byte
    at which a line begins; offsets are a byte for each file, so a poll reads what was added since and no more. Option
    `after` (JSON of file names to bytes) says where a new stream begins in a file: at the first line from that byte on.
    A line counts once its newline is written. Files only grow, and offsets hold a number for each."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _TailReader(self.options["path"], self.options.get("ending", ".log"), json.loads(self.options.get("after", "{}")), int(self.options.get("range", RANGE)))


class _TailReader(DataSourceStreamReader):
    def __init__(self, path: str, ending: str, after: dict[str, int], span: int) -> None:
        self.path, self.ending, self.after, self.span, self.seen = path, ending, after, span, {}

    def initialOffset(self) -> dict:  # noqa: N802
        fs, place = pa.fs.FileSystem.from_uri(self.path)
        return {f"{place.rstrip('/')}/{name}": at for name, at in self.after.items()}

    def latestOffset(self, *_: object) -> dict:  # noqa: N802
        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        for f in _files(self.path, self.ending):
            before = self.seen.get(f.path, 0)
            if f.size > before:
                self.seen[f.path] = self._last_end(fs, f.path, before, f.size)
        return dict(self.seen)

    def _last_end(self, fs: pa.fs.FileSystem, path: str, low: int, high: int) -> int:
        """Where the last whole line before high ends; low if none does."""
        with fs.open_input_file(path) as raw:
            while high > low:
                start = max(low, high - BLOCK)
                raw.seek(start)
                place = raw.read(high - start).rfind(b"\n")
                if place >= 0:
                    return start + place + 1
                high = start
        return low

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, last in end.items():
            first = start.get(path, 0)
            out += [InputPartition((path, a, min(last, a + self.span))) for a in range(first, last, self.span)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """Lines that begin within the range; the last may end beyond it."""
        path, first, last = partition.value
        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        with fs.open_input_file(path) as raw:
            at = first
            if first:  # a line that began before is another task's
                raw.seek(first - 1)
                at, found = first - 1, False
                while not found:
                    block = raw.read(BLOCK)
                    place = block.find(b"\n")
                    found, at = place >= 0 or not block, at + (place + 1 if place >= 0 else len(block))
            raw.seek(at)
            rest = b""
            while at < last and (block := raw.read(BLOCK)):
                *lines, rest = (rest + block).split(b"\n")
                starts, kept = [], []
                for line in lines:
                    if at >= last:
                        break
                    starts.append(at)
                    kept.append(line)
                    at += len(line) + 1
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(kept), pa.string()), pa.array(starts, pa.int64()), _text(kept)], names=["file", "at", "line"])

    def commit(self, end: dict) -> None:
        pass


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ZippedLines)
    return spark.read.format("zipped_lines").load(path)


def log_tail(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").options(**options).load(path)


def write_lines(rows: DataFrame, path: str, order: list[str], packed: bool = False) -> None:
    """Write the lines of rows (file, line) to one file of each name in that folder, in order; packed as the one member of a
    zip file of that name. A file is written under another name first, so that a task that runs twice leaves it whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(place)
        now, out, close = None, None, lambda: None

        def begin(name: str):  # noqa: ANN202
            whole = f"{place}/{name}"
            part = f"{whole}.{TaskContext.get().taskAttemptId()}.part"
            raw = fs.open_output_stream(part)
            archive = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) if packed else None
            text = archive.open(name.removesuffix(".zip"), "w", force_zip64=True) if packed else raw

            def end() -> None:
                text.close()
                if archive:
                    archive.close()
                    raw.close()
                fs.move(part, whole)

            return text, end

        for batch in batches:
            names, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = 0
            for i in range(1, len(names) + 1):
                if i < len(names) and names[i] == names[start]:
                    continue
                if names[start] != now:
                    close()
                    now = names[start]
                    out, close = begin(now)
                out.write(("\n".join(lines[start:i]) + "\n").encode())
                start = i
            yield batch.slice(0, 0)
        close()

    dealt = rows.repartition("file").sortWithinPartitions("file", *order).select("file", "line")
    dealt.mapInArrow(run, "file string, line string").write.format("noop").mode("overwrite").save()


def _fields(lines: DataFrame, start: int | None, end: int | None, schema: str, time: str) -> DataFrame:
    """Fields of CSV lines whose first field is a number and lies between two times, both inclusive. Missing ones are null."""
    rows = lines.where(F.col("line").rlike("^[0-9]+(,|$)")).select("file", F.from_csv("line", schema).alias("x")).select("file", "x.*")
    if start is not None:
        rows = rows.where(F.col(time) >= start)
    return rows if end is None else rows.where(F.col(time) <= end)


def zipped_klines(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Candles of zipped CSV files with the file's name, by open_time. A quote volume or number of trades that a line lacks is zero."""
    names = "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, trade_count long"
    return _fields(zipped_lines(spark, path), start, end, names, "open_time").fillna(0, ["quote_volume", "trade_count"]).orderBy("open_time")


def zipped_funding(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Funding rates of zipped CSV files with the file's name, by funding_time. A mark price that a line lacks is zero."""
    return _fields(zipped_lines(spark, path), start, end, "funding_time long, rate double, mark_price double", "funding_time").fillna(0, ["mark_price"]).orderBy("funding_time")
