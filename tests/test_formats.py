"""Snapshots, quotes and feeds through Spark's readers and streams."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.sources import formats

from .conftest import same


@pytest.fixture
def own(spark):
    formats.register(spark)
    return spark


def snapshot(root, commit="abc"):
    top = root / "datasets--org--news"
    (top / "refs").mkdir(parents=True, exist_ok=True)
    (top / "refs" / "main").write_text(commit)
    return top / "snapshots" / commit


def test_snapshot_splits_configurations_and_revisions(own, tmp_path):
    top = snapshot(tmp_path)
    (top / "pt").mkdir(parents=True)
    (top / "data").mkdir()
    for k in range(2):
        pq.write_table(pa.table({"id": [k * 10 + i for i in range(10)], "x": [float(i) for i in range(10)], "s": [None if i == 3 else f"t{i}" for i in range(10)]}), top / "data" / f"train-0000{k}-of-00002.parquet", row_group_size=4)
    (top / "pt" / "test.csv").write_text('id,s\n007,"a\nb"\n8,""\n')
    (top / "pt" / "train.jsonl").write_text("".join(json.dumps({"id": i, "s": f"j{i}"}) + "\n" for i in range(3)))
    read = lambda **o: own.read.format("snapshot").options(path=str(tmp_path), dataset="org/news", **o).load()
    whole = read()
    assert whole.count() == 20 and whole.rdd.getNumPartitions() == 6  # row groups of four rows in two files
    some = lambda *conditions, **o: [tuple(r) for r in read(where=json.dumps(conditions), **o).collect()]
    same(some(("id", ">=", 8), ("id", "<", 12), ("s", "is not null", None), ("x", ">", 0)), [(8, 8.0, "t8"), (9, 9.0, "t9"), (11, 1.0, "t1")])
    same(some(("s", "is null", None), columns="id"), [(3,), (13,)])
    same(some(("s", "in", ["t1", "t2"]), ("id", "!=", 12), columns="s, id"), [("t1", 1), ("t2", 2), ("t1", 11)])
    # Conditions of Spark's own hold for their query alone, though the relation is the same.
    assert [whole.count(), whole.where("id > 17").count(), whole.where("s is null").count(), whole.count()] == [20, 2, 2, 20]
    with pytest.raises(PySparkException, match="no column 'z'"):
        read(columns="id,z").count()
    same([tuple(r) for r in read(config="pt", split="test").collect()], [("007", "a\nb"), ("8", "")])
    same([tuple(r) for r in read(config="pt", revision="abc").collect()], [(i, f"j{i}") for i in range(3)])
    for o in ({"split": "gone"}, {"revision": "gone"}, {"config": "gone"}):
        with pytest.raises(PySparkException, match="gone"):
            read(**o).count()


def test_quotes(own, tmp_path):
    for t in "AB":
        (tmp_path / f"{t}.csv").write_text("Date,Open,Close\n2024-01-01,1,10.5\n2024-01-02,1,11\n2024-01-03,1,\n")
    (tmp_path / "none.csv").write_text("Date,Close\n")
    read = lambda tickers, **o: own.read.format("quotes").options(url=str(tmp_path / "{ticker}.csv"), tickers=tickers, **o).load()
    same([tuple(r) for r in read("A,B", start="2024-01-02").collect()], [(d, t, c) for t in "AB" for d, c in (("2024-01-02", 11.0), ("2024-01-03", None))])
    assert read("A", end="2024-01-03").count() == 2 and read("A,B").rdd.getNumPartitions() == 2
    for tickers, message in (("A,none", "no quotes for none"), ("A,gone", "gone")):
        with pytest.raises(PySparkException, match=message):
            read(tickers).collect()


def items(*rows):
    return "<rss><channel>" + "".join(f"<item><link>{link}</link><title>T {link}</title><pubDate>{day}</pubDate></item>" for link, day in rows) + "</channel></rss>"


def test_feed_as_table_and_stream(own, tmp_path):
    a, b = tmp_path / "a.xml", tmp_path / "b.xml"
    first, second, third = (f"Fri, 0{d} Mar 2024 10:00:00 GMT" for d in (1, 2, 3))
    a.write_text(items(("a1", first), ("a2", second), ("a0", "no day")))
    b.write_text(items(("b1", first)))
    paths = f"{a} {b}"
    assert {r.url for r in own.read.format("feed").load(paths).where("published >= '2024-03-02'").collect()} == {"a2"}

    def run():
        stream = own.readStream.format("feed").load(paths).withColumn("day", F.to_date("published"))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        return sorted(r.url for r in own.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["a0", "a1", "a2", "b1"]
    a.write_text(items(("a3", second), ("a4", third), ("a2", second)))  # one more of the same time, one later, one seen
    assert run() == ["a0", "a1", "a2", "a3", "a4", "b1"]
    assert run() == ["a0", "a1", "a2", "a3", "a4", "b1"]


def test_feeds_of_a_folder_are_read_by_tasks(own, tmp_path):
    first, second, third = (f"Fri, 0{d} Mar 2024 10:00:00 GMT" for d in (1, 2, 3))
    (tmp_path / "feeds").mkdir()
    put = lambda name, *rows: (tmp_path / "feeds" / name).write_text(items(*rows))
    put("a.xml", ("a1", first), ("a2", second), ("a0", "no day"))

    def run():
        stream = own.readStream.format("feed").option("seen", str(tmp_path / "seen")).load(f"{tmp_path}/feeds/")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted(r.url for r in own.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["a0", "a1", "a2"]
    put("a.xml", ("a3", second), ("a4", third), ("a2", second))
    put("b.xml", ("b1", first))  # a feed that was not there
    assert run() == ["a0", "a1", "a2", "a3", "a4", "b1"]
    put("a.xml", ("a4", third), ("a5", third))
    assert run() == ["a0", "a1", "a2", "a3", "a4", "a5", "b1"] == run()


def test_a_feed_of_many_items_takes_bounded_memory(tmp_path):
    import tracemalloc

    from tidemark.sources.formats import feed_items

    (tmp_path / "long.xml").write_text(items(*((f"a{k}", "Fri, 01 Mar 2024 10:00:00 GMT") for k in range(30_000))))
    tracemalloc.start()
    assert sum(1 for _ in feed_items(str(tmp_path / "long.xml"))) == 30_000
    assert tracemalloc.get_traced_memory()[1] < 2_000_000
    tracemalloc.stop()
