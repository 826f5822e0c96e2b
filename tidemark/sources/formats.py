"""Formats of the engine's own for ``spark.read`` and ``spark.readStream``: dataset snapshots, quotes and feeds.

``snapshot`` reads a split of a dataset as hubs keep it on disk or in a store (``<path>/datasets--<owner>--<name>`` with
``refs/<revision>`` and ``snapshots/<commit>/[<config>/]<split>...``). A partition is a row group of parquet or a file of
CSV or lines of JSON. CSV columns are text. The options ``columns`` (names, separated by commas) and ``where`` (a JSON list of
[column, operator, value]) choose columns and rows where they are read, and row groups by their statistics. They are
options because this version of Spark keeps what a relation's ``pushFilters`` took for the relation's later scans.

``quotes`` reads daily closes, a partition a ticker (``tickers``, separated by commas), from tables of CSV at an address with ``{ticker}``, ``{start}`` and
``{end}`` in it. A ticker without rows is an error, like a failed request.

``feed`` reads the items of RSS feeds (files, addresses or folders that end with a slash, separated by blanks), item by item. As a
stream, a batch holds what was published after the items of the batch before. With the option ``seen``, a folder that driver and
executors share, a task reads each feed that has changed: the offset is each feed's version (time and size, or tag), and the task
keeps there the last time of that version and the links that have it, which the next batch starts from. Without, the offset is
those themselves and the driver reads the feeds, which will do for short ones.

``register`` makes them known to a session.
"""

from __future__ import annotations

import hashlib
import io
import json
import time
import urllib.request
import uuid
from collections.abc import Iterator
from datetime import UTC
from email.utils import parsedate_to_datetime
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.csv
import pyarrow.dataset
import pyarrow.fs
import pyarrow.json
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

#: Kinds of files that a snapshot is made of, by the ends of their names.
KINDS = {".parquet": "parquet", ".jsonl": "json", ".json": "json", ".csv": "csv"}


def register(spark: SparkSession) -> None:
    for source in (Snapshot, Quotes, Feed):
        spark.dataSource.register(source)


def _store(address: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(address if "://" in address else f"file://{address}" if address.startswith("/") else address)


def read_bytes(address: str, timeout: float = 30.0) -> bytes:
    """A web address' or a stored file's bytes."""
    if address.startswith(("http://", "https://")):
        with urllib.request.urlopen(address, timeout=timeout) as reply:  # noqa: S310
            return reply.read()
    store, path = _store(address)
    with store.open_input_stream(path) as f:
        return f.read()


# ---- snapshots ----


class Snapshot(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def files(self) -> list[str]:
        """The split's files, in the order of their names."""
        o = self.options
        store, root = _store(o["path"])
        root = f"{root.rstrip('/')}/datasets--{o['dataset'].replace('/', '--')}" if o.get("dataset") else root.rstrip("/")
        revision, config, split = o.get("revision", "main"), o.get("config", "default"), o.get("split", "train")
        ref = f"{root}/refs/{revision}"
        if store.get_file_info(ref).type == pyarrow.fs.FileType.File:
            with store.open_input_stream(ref) as f:
                revision = f.read().decode().strip()
        top = f"{root}/snapshots/{revision}"
        if store.get_file_info(top).type != pyarrow.fs.FileType.Directory:
            raise FileNotFoundError(f"no revision {revision!r} of {o.get('dataset') or o['path']!r}")
        folders = [f"{top}/{config}", *([f"{top}/data", top] if config == "default" else [])]
        for folder in folders:
            infos = store.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
            # <split>.csv, <split>-00000-of-00002.parquet
            found = sorted(i.path for i in infos if i.type == pyarrow.fs.FileType.File and i.extension and f".{i.extension}" in KINDS and i.base_name.split(".")[0].split("-")[0] == split)
            if found:
                return found
        raise FileNotFoundError(f"no split {split!r} of configuration {config!r}")

    def schema(self):
        store, _ = _store(self.options["path"])
        whole = _dataset(self.files()[0], store).schema
        wanted = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else whole.names
        if absent := sorted({*wanted, *(c for c, _, _ in self.conditions())} - {*whole.names}):
            raise ValueError(f"the split has no column {absent[0]!r}")
        return from_arrow_schema(pa.schema([whole.field(c) for c in wanted]))

    def conditions(self) -> list[tuple]:
        return json.loads(self.options.get("where", "[]"))

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options["path"], self.files(), schema, self.conditions())


def _kind(path: str) -> str:
    return next(k for end, k in KINDS.items() if path.endswith(end))


def _dataset(path: str, store) -> pyarrow.dataset.Dataset:
    kind, form = _kind(path), None
    if kind == "csv":
        with store.open_input_stream(path) as f:
            names = pyarrow.csv.open_csv(f).schema.names
        form = pyarrow.dataset.CsvFileFormat(convert_options=pyarrow.csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=True, quoted_strings_can_be_null=False))
    return pyarrow.dataset.dataset(path, filesystem=store, format=form or kind)


class Part(D.InputPartition):
    def __init__(self, path: str, row_group: int | None) -> None:
        super().__init__(None)
        self.path, self.row_group = path, row_group


#: Conditions by their operators; a null fulfils none but its own.
OPERATORS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(v) & c.is_valid(), "is null": lambda c, _: c.is_null(), "is not null": lambda c, _: c.is_valid(),
}


class SnapshotReader(D.DataSourceReader):
    def __init__(self, address: str, files: list[str], schema, conditions: list[tuple]) -> None:
        self.address, self.paths, self.schema, self.conditions = address, files, to_arrow_schema(schema), conditions

    def _expression(self) -> pyarrow.dataset.Expression | None:
        made = [OPERATORS[operator](pyarrow.dataset.field(column), value) for column, operator, value in self.conditions]
        return reduce(lambda a, b: a & b, made) if made else None

    def partitions(self):
        store, _ = _store(self.address)
        out = []
        for path in self.paths:
            groups = [None] if _kind(path) != "parquet" else range(next(_dataset(path, store).get_fragments()).num_row_groups)
            out += [Part(path, g) for g in groups]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.address)
        whole = _dataset(partition.path, store)
        fragment = next(whole.get_fragments())
        if partition.row_group is not None:
            fragment = fragment.subset(row_group_ids=[partition.row_group])
        present = [f.name for f in self.schema if f.name in whole.schema.names]
        for batch in fragment.to_batches(filter=self._expression(), columns=present, batch_size=10_000):
            if batch.num_rows:
                columns = [batch.column(f.name).cast(f.type) if f.name in present else pa.nulls(batch.num_rows, f.type) for f in self.schema]
                yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


# ---- quotes ----


class Quotes(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "quotes"

    def schema(self) -> str:
        return "date string, ticker string, close double"

    def reader(self, schema) -> QuotesReader:
        return QuotesReader(self.options)


class QuotesReader(D.DataSourceReader):
    def __init__(self, options) -> None:
        self.url, self.tickers = options["url"], [t.strip() for t in options["tickers"].split(",") if t.strip()]
        self.names = [options.get(k, k).lower() for k in ("date", "close")]
        self.window = {k: options.get(k, "") for k in ("start", "end")}

    def partitions(self):
        return [D.InputPartition(t) for t in self.tickers]

    def read(self, partition) -> Iterator[tuple]:
        text = read_bytes(self.url.format(ticker=partition.value, **self.window))
        table = pyarrow.csv.read_csv(pa.BufferReader(text), convert_options=pyarrow.csv.ConvertOptions(timestamp_parsers=[]))
        columns = {name.strip().lower(): column for name, column in zip(table.column_names, table.columns, strict=True)}
        if absent := [n for n in self.names if n not in columns]:
            raise ValueError(f"quotes of {partition.value} have no column {absent[0]!r}")
        if not table.num_rows:
            raise ValueError(f"no quotes for {partition.value}")
        days, closes = (columns[n] for n in self.names)
        low, high = self.window["start"], self.window["end"]
        for day, close in zip(days.cast(pa.string()).to_pylist(), closes.to_pylist(), strict=True):
            if not low or low <= (day or "")[:10]:
                if not high or (day or "")[:10] < high:
                    yield (day[:10] if day else None, partition.value, float(close) if close is not None else None)


# ---- feeds ----


class Feed(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "feed string, url string, title string, description string, published timestamp"

    def reader(self, schema) -> FeedReader:
        return FeedReader(feed_addresses(self.options["path"]))

    def streamReader(self, schema) -> FeedTasks:
        return FeedTasks(self.options["path"], self.options["seen"]) if self.options.get("seen") else super().streamReader(schema)

    def simpleStreamReader(self, schema) -> FeedStream:
        return FeedStream(self.options["path"])


def feed_addresses(path: str) -> list[str]:
    """The feeds that ``path`` names; of a folder all its files."""
    out = []
    for address in path.split():
        if address.endswith("/"):
            store, root = _store(address)
            infos = store.get_file_info(pyarrow.fs.FileSelector(root.rstrip("/"), allow_not_found=True))
            out += sorted(address + i.base_name for i in infos if i.type == pyarrow.fs.FileType.File and i.base_name[0] not in "._")
        else:
            out.append(address)
    return out


def _opened(address: str):
    if address.startswith(("http://", "https://")):
        return io.BytesIO(read_bytes(address))
    store, path = _store(address)
    return store.open_input_stream(path)


def feed_items(address: str) -> Iterator[tuple]:
    """(feed, url, title, description, published) of each item; a time that can't be read is null. Items are let go as they are read."""
    with _opened(address) as f:
        above = []
        for event, element in ElementTree.iterparse(f, ("start", "end")):  # noqa: S314  expat bounds the expansion of entities
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if element.tag != "item":
                continue
            text = {k: (element.findtext(k) or "").strip() for k in ("link", "title", "description", "pubDate")}
            if above:
                above[-1].remove(element)
            try:
                published = parsedate_to_datetime(text["pubDate"])
                published = (published if published.tzinfo else published.replace(tzinfo=UTC)).astimezone(UTC)
            except (ValueError, TypeError):
                published = None
            yield (address, text["link"], text["title"], text["description"], published)


def _place(item: tuple) -> str:
    return item[4].isoformat() if item[4] else ""


class FeedReader(D.DataSourceReader):
    def __init__(self, feeds: list[str]) -> None:
        self.feeds = feeds

    def partitions(self):
        return [D.InputPartition(f) for f in self.feeds]

    def read(self, partition) -> Iterator[tuple]:
        yield from feed_items(partition.value)


class FeedStream(D.SimpleDataSourceStreamReader):
    """New items by feed. An item without a readable time counts as the oldest, so it comes with a feed's first batch."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def _after(self, feed: str, start: dict) -> list[tuple]:
        last, links = json.loads(start[feed]) if feed in start else ["", []]
        return [i for i in feed_items(feed) if _place(i) > last or (_place(i) == last and i[1] not in links)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for feed in feed_addresses(self.path):
            if fresh := self._after(feed, start):
                last = max(map(_place, fresh))
                before, links = json.loads(start[feed]) if feed in start else ["", []]
                end[feed] = json.dumps([last, sorted({*(links if last == before else []), *(i[1] for i in fresh if _place(i) == last)})])
                rows += fresh
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same batch again after a failure, as far as the feeds still show its items."""
        for feed in feed_addresses(self.path):
            if feed in end:
                last, links = json.loads(end[feed])
                yield from (i for i in self._after(feed, start) if _place(i) < last or (_place(i) == last and i[1] in links))


class FeedPart(D.InputPartition):
    def __init__(self, feed: str, before: str | None, version: str) -> None:
        super().__init__(None)
        self.feed, self.before, self.version = feed, before, version


def feed_version(address: str, timeout: float = 30.0) -> str:
    """What changes with a feed; of an address without a tag or a date it is the time, so it is read each time."""
    if address.startswith(("http://", "https://")):
        with urllib.request.urlopen(urllib.request.Request(address, method="HEAD"), timeout=timeout) as reply:  # noqa: S310
            return reply.headers.get("ETag") or reply.headers.get("Last-Modified") or str(time.time_ns())
    store, path = _store(address)
    info = store.get_file_info(path)
    if info.type != pyarrow.fs.FileType.File:
        raise FileNotFoundError(address)
    return f"{info.mtime_ns}-{info.size}"


class FeedTasks(D.DataSourceStreamReader):
    """New items by feed, each feed read by a task. A batch that is run again reads what the feeds show then."""

    def __init__(self, path: str, seen: str) -> None:
        self.path, self.seen = path, seen.rstrip("/")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {feed: feed_version(feed) for feed in feed_addresses(self.path)}

    def partitions(self, start: dict, end: dict) -> list[FeedPart]:
        return [FeedPart(feed, start.get(feed), version) for feed, version in end.items() if start.get(feed) != version]

    def _mark(self, feed: str, version: str) -> str:
        return f"{self.seen}/{hashlib.sha256(f'{feed} {version}'.encode()).hexdigest()}"

    def read(self, partition: FeedPart) -> Iterator[tuple]:
        last, links = json.loads(read_bytes(self._mark(partition.feed, partition.before))) if partition.before else ["", []]
        before, known = last, {*links}
        links = {*links}
        for item in feed_items(partition.feed):
            at = _place(item)
            if at < before or (at == before and item[1] in known):
                continue
            if at > last:
                last, links = at, set()
            if at == last:
                links.add(item[1])
            yield item
        store, path = _store(self._mark(partition.feed, partition.version))
        store.create_dir(path.rsplit("/", 1)[0])
        with store.open_output_stream(made := f"{path}.{uuid.uuid4().hex}") as f:
            f.write(json.dumps([last, sorted(links)]).encode())
        store.move(made, path)
