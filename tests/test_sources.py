"""File framing against one sequential reader, and the stream of committed generations."""

import os
import random
from pathlib import Path

import pytest
from helpers import fails, rows
from pyspark.sql import functions as F

from plumbline.guards import LimitError
from plumbline.plans import quality
from plumbline.session import run_folder
from plumbline.sources import committed, datasets, files
from plumbline.streaming import publish, runs

PIECES = [b"\n", b"\r\n", b"\r", b"abc", "é終".encode(), b", ", b"", b"\xff", b"\xe2\x82", b"\xf0\x9f\x98"]


def sequential(data, delimiter):
    """One reader over the whole file: ordinal, start, end, delimiter_end, unterminated, content."""
    out, at, separator = [], 0, delimiter or b"\n"
    while at < len(data):
        found = data.find(separator, at)
        if found < 0:
            out.append((len(out), at, len(data), len(data), True, data[at:]))
            break
        end = found - 1 if delimiter is None and data[at:found].endswith(b"\r") else found
        out.append((len(out), at, end, found + len(separator), False, data[at:end]))
        at = found + len(separator)
    return out


def runs_of(content):
    """Runs of valid and of invalid bytes, and the first invalid span."""
    count, bad, rest, at = 0, None, content, 0
    while rest:
        try:
            rest.decode()
            return count + 1, bad
        except UnicodeDecodeError as error:
            count += 1 + (error.start > 0)
            bad = bad or (at + error.start, at + error.end)
            at, rest = at + error.end, rest[error.end :]
    return count, bad


@pytest.fixture
def ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def set_size(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 0)

    yield set_size
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("delimiter", [None, ", ", "終"])
def test_frames_are_those_of_a_sequential_reader(spark, ranges, tmp_path, delimiter):
    draw = random.Random(9)
    wanted = {}
    for k, count in enumerate([0, 1, 40, 900, 900, 1500]):
        data = b"".join(draw.choice(PIECES) for _ in range(count))
        data = b"\xef\xbb\xbfx" + data if k in (2, 4) and delimiter != "終" else data
        (tmp_path / f"f{k}").write_bytes(data)
        wanted[f"f{k}"] = sequential(data, delimiter.encode() if delimiter else None)
    for size in (1 << 27, 500, 61):
        ranges(size)
        for decoding in ("lossy", "strict"):
            found = {name: [] for name in wanted}
            for r in files.frame_files(spark, str(tmp_path), delimiter, decoding).collect():
                found[os.path.basename(r.file)].append(r)
            for name, want in wanted.items():
                got = sorted(found[name], key=lambda r: r.ordinal)
                assert [(r.ordinal, r.start, r.end, r.delimiter_end, r.unterminated) for r in got] == [w[:5] for w in want]
                for r, w in zip(got, want):
                    spans, bad = runs_of(w[5])
                    if bad and decoding == "strict":
                        assert (r.reason, r.text, r.reason_start, r.reason_end) == ("invalid_utf8", None, w[1] + bad[0], w[1] + bad[1])
                        assert bytes(r.excerpt) == w[5][: files.MAX_EXCERPT]
                    else:
                        assert (r.reason, r.text, r.spans, r.lossy) == (None, w[5].decode("utf-8", "replace"), spans, bad is not None)


def test_every_limit_has_its_reason(spark, tmp_path):
    lines = [b"good", b"x" * 21, b"\xff\xff\xff", b"a\xffb\xffc", b"ok\xff"]
    (tmp_path / "f").write_bytes(b"\n".join(lines))
    framed = files.frame_files(spark, str(tmp_path), decoding="lossy", raw_limit=20, decoded_limit=8, span_limit=4, excerpt=2)
    got = {r.ordinal: (r.reason, r.reason_start, r.reason_end, bytes(r.excerpt), r.excerpt_truncated) for r in files.rejections(framed).collect()}
    assert got == {
        1: ("raw_limit", 5, 26, b"xx", True),
        2: ("decoded_limit", 27, 30, b"\xff\xff", True),
        3: ("decoded_limit", 31, 36, b"a\xff", True),
    }
    framed = files.frame_files(spark, str(tmp_path), decoding="lossy", span_limit=4)
    assert [(r.ordinal, r.reason) for r in files.rejections(framed).collect()] == [(3, "span_limit")]
    fails(files.strict_records(framed), "malformed record: span_limit at 31")
    for wrong in ("aa", "", "aba"):
        with pytest.raises(LimitError):
            files.frame_files(spark, str(tmp_path), wrong)


def rows_of(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("n"), F.timestamp_micros(F.col("id") * 1_000_001).alias("t"), F.array("id").alias("list"))


def test_followers_see_commits_only(spark):
    path, folder = run_folder(spark, "test"), run_folder(spark, "test")
    with pytest.raises(LimitError):
        publish.dataset_follow(spark, path)
    datasets.append(rows_of(spark, 0, 10), path, 0, "n")
    follow = lambda: runs.run_to_table(publish.dataset_follow(spark, path), "test", folder)
    assert follow().count() == 10
    rows_of(spark, 50, 60).withColumn("ordinal", F.col("n")).write.parquet(f"{path}/records/generation=2")
    assert follow().count() == 10
    datasets.append(rows_of(spark, 10, 25), path, 1, "n")
    got = follow()
    assert sorted((r.n, r.ordinal, r.generation) for r in got.collect()) == [(i, i, int(i >= 10)) for i in range(25)]
    assert sorted(map(repr, got.select("n", "t", "list").collect())) == sorted(map(repr, rows_of(spark, 0, 25).collect()))
    assert follow().count() == 25  # a restart reads nothing again


def test_next_begins_behind_the_last_commit(spark):
    path, folder = run_folder(spark, "test"), run_folder(spark, "test")
    for generation in range(2):
        datasets.append(rows_of(spark, generation * 5, generation * 5 + 5), path, generation, "n")
    stream = publish.dataset_follow(spark, path, "next")
    assert runs.run_to_table(stream, "test", folder).count() == 0
    datasets.append(rows_of(spark, 10, 13), path, 2, "n")
    assert sorted(r.n for r in runs.run_to_table(stream, "test", folder).collect()) == [10, 11, 12]
    spark.dataSource.register(committed.CommittedGenerations)
    table = spark.read.format(committed.FORMAT).schema("n bigint, generation int").option("path", f"file://{path}").load()
    assert table.where("generation < 2").count() == 10 and table.count() == 13
    with pytest.raises(LimitError):
        publish.dataset_follow(spark, path, "later")


def test_pieces_of_a_file_number_on(spark, tmp_path, monkeypatch):
    texts = ["a\nb", "\ufeffc", "", "d\r", "\ufeff", "ee\n\nf"]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "whole").write_bytes("".join(t + "\n" for t in texts).encode())
    (tmp_path / "many" / "x").mkdir(parents=True)
    for i, text in enumerate(texts):
        (tmp_path / "many" / "x" / f"part-{i:05}").write_bytes((text + "\n").encode())
    columns = ["ordinal", "start", "end", "delimiter_end", "unterminated", "text", "spans"]
    frame = lambda folder, **more: files.frame_files(spark, str(tmp_path / folder), **more)
    want = rows(frame("one/whole"), *columns)
    assert rows(frame("many/x", pieces=True), *columns) == want and len(want) == 9
    assert {r.file.rsplit("/", 1)[1] for r in frame("many/x", pieces=True).select("file").collect()} == {"x"}
    with open(tmp_path / "many" / "x" / "part-00002", "ab") as piece:
        piece.write(b"open")
    fails(frame("many/x", pieces=True), "ends within a record")


def test_parts_are_written_in_bounded_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{i} " * 50 + "\n") for i in range(100)], "doc_id bigint, text string")
    monkeypatch.setattr(quality, "PIECE_BYTES", 500)
    path = quality._written_parts(docs, spark, "pieces")
    sizes = [p.stat().st_size for p in Path(path.removeprefix("file:")).glob("part=*/*.txt")]
    assert len(sizes) > 30 and max(sizes) < 1500
    framed = files.frame_files(spark, path, pieces=True).where("text <> ''").orderBy("file", "start").collect()
    want = [(i % 8, str(i)) for i in sorted(range(100), key=lambda i: (i % 8, i))]
    assert [(int(r.file[-1]), r.text.split()[0]) for r in framed] == want
    assert [r.ordinal for r in framed[:13]] == [*range(0, 26, 2)]
