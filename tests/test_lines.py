"""Data sources of lines: zipped CSV files and logs that grow."""

from __future__ import annotations

import json
import zipfile

from tidewright.sources import lines
from tidewright.streaming import live


def test_zipped_members_headers_short_lines_and_both_bounds(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.csv.zip", "w") as z:
        z.writestr("a.csv", "open_time,open\r\n1,1,2,0.5,1.5,9,2,18.5,4\r\n2,1,2,0.5,1.5,9,3\r\n\r\nx,1\r\n4,1,2,0.5,1.5,9,5,1,1")
        z.writestr("b.csv", "3,1,2,0.5,1.5,9,4\n0,1,2,0.5,1.5,9,1\n")
        z.writestr("none.csv", "")
    with zipfile.ZipFile(tmp_path / "f.csv.zip", "w") as z:
        z.writestr("f.csv", "7,0.1\n8,0.2,5.5\n")
    (tmp_path / "c.csv").write_text("9,9\n")  # no zip file
    path = f"file://{tmp_path}"
    got = lines.zipped_klines(spark, f"{path}/a.csv.zip", 1, 3).drop("file").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 0.5, 1.5, 9, 2, 18.5, 4), (2, 1, 2, 0.5, 1.5, 9, 3, 0, 0), (3, 1, 2, 0.5, 1.5, 9, 4, 0, 0)]
    assert [(r.funding_time, r.rate, r.mark_price) for r in lines.zipped_funding(spark, f"{path}/f.csv.zip").collect()] == [(7, 0.1, 0.0), (8, 0.2, 5.5)]
    assert lines.zipped_lines(spark, path).select("file").distinct().count() == 2
    assert lines.zipped_lines(spark, f"{path}/nothing").count() == 0


def test_lines_longer_than_a_block(spark, tmp_path, monkeypatch):
    long = "1," + "7" * (lines.BLOCK + 10)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a", f"{long}\n2,é\n")
    assert [len(r.line) for r in lines.zipped_lines(spark, f"file://{tmp_path}").collect()] == [len(long), 3]


def _poll(spark, path, **options):
    live.go_on(lines.log_tail(spark, f"{path}/logs", **options), f"{path}/out", f"{path}/at", None).awaitTermination()
    return sorted((r.file.rsplit("/", 1)[1], r.at, r.line) for r in spark.read.parquet(f"{path}/out").collect())


def test_tail_reads_what_was_added_since(spark, tmp_path):
    path, log = f"file://{tmp_path}", tmp_path / "logs" / "a.log"
    log.parent.mkdir()
    log.write_text("one\n\nthree and more\nfo")
    assert _poll(spark, path, range="3") == [("a.log", 0, "one"), ("a.log", 4, ""), ("a.log", 5, "three and more")]
    with log.open("a") as f:
        f.write("ur\n")
    (log.parent / "b.log").write_text("other\n")
    (log.parent / "c.txt").write_text("no log\n")
    got = _poll(spark, path, range="3")
    assert got == [("a.log", 0, "one"), ("a.log", 4, ""), ("a.log", 5, "three and more"), ("a.log", 20, "four"), ("b.log", 0, "other")]
    assert _poll(spark, path) == got  # nothing new


def test_tail_begins_after_a_byte_of_the_caller(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("one\ntwo\nthree\n")
    assert _poll(spark, f"file://{tmp_path}", after=json.dumps({"a.log": 4})) == [("a.log", 4, "two"), ("a.log", 8, "three")]


def test_follow_ends_with_the_terminal_event(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("start\n")
    path, polls = f"file://{tmp_path}", []

    def pause(seconds: float) -> None:
        polls.append(seconds)
        with (tmp_path / "logs" / "a.log").open("a") as f:
            f.write("work\n" if len(polls) < 2 else "complete\n")

    tail = lambda: lines.log_tail(spark, f"{path}/logs")
    assert live.follow_until(tail, f"{path}/out", f"{path}/at", "line = 'complete'", 0.1, pause=pause)
    assert polls == [0.1, 0.1] and sorted(r.line for r in spark.read.parquet(f"{path}/out").collect()) == ["complete", "start", "work"]
    assert not live.follow_until(tail, f"{path}/out", f"{path}/at", "line = 'never'", 0.0, polls=2, pause=lambda _: None)
