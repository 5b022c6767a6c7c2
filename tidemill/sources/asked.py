"""Stored answers of feeds and boards as a data source: spark.read.format("feeds"), with a parser registered for each kind."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import feeds

#: What a parser may give for an item.
FIELDS = ["title", "link", "location", "posted", "summary"]
SCHEMA = "source_id string, kind string, state string, ordinal int, " + ", ".join(f"{f} string" for f in FIELDS) + ", error string"
_PARSERS: dict[str, Callable[[str], list[dict]]] = {}
_KEYED: set[str] = set()


def register(kind: str, keyed: bool = False):
    """Makes a function from an answer to a list of items (dictionaries of FIELDS) the parser of a kind; keyed kinds are skipped without their key.

    What an own module registers must be registered where tasks run as well: name the module in the option modules.
    """

    def add(parser: Callable[[str], list[dict]]):
        _PARSERS[kind] = parser
        if keyed:
            _KEYED.add(kind)
        return parser

    return add


def _at(item: dict, path: str):
    for name in path.split("."):
        item = item.get(name) if isinstance(item, dict) else None
    return item


@register("rss")
def _feed(body: str) -> list[dict]:
    return [{"title": i["title"], "link": i["link"], "posted": i["published"], "summary": i["summary"]} for i in feeds.parse(body)]


@register("lever")
def _lever(body: str) -> list[dict]:
    return [{"title": i.get("text"), "link": i.get("hostedUrl"), "location": _at(i, "categories.location"), "posted": i.get("createdAt"), "summary": i.get("descriptionPlain")} for i in json.loads(body)]


def _board(items_at: str, fields: dict[str, str]) -> Callable[[str], list[dict]]:
    return lambda body: [{f: _at(i, path) for f, path in fields.items()} for i in json.loads(body).get(items_at) or []]


for _kind, (_, _items, _fields) in feeds.BOARDS.items():
    register(_kind, keyed=_kind in feeds.KEYED)(_board(_items, _fields))


def rows_of(source: str | None, kind: str | None, body: str | None, keys: set[str]) -> list[tuple]:
    """Rows of SCHEMA: one an item, or one that says why there is none: error (unknown kind, unreadable, empty) or skipped (no key)."""
    none = (None,) * len(FIELDS)
    if kind not in _PARSERS:
        return [(source, kind, "error", 0, *none, f"no adapter for {kind}")]
    if kind in _KEYED and kind not in keys:
        return [(source, kind, "skipped", 0, *none, f"{kind} needs a key")]
    try:
        items = _PARSERS[kind](body or "")
    except Exception as e:  # whatever a source answers, the others are read
        return [(source, kind, "error", 0, *none, f"unreadable: {type(e).__name__}")]
    text = lambda v: None if v is None else str(v)
    return [(source, kind, "ok", i, *(text(item.get(f)) for f in FIELDS), None) for i, item in enumerate(items)] or [(source, kind, "error", 0, *none, "empty answer")]


@dataclass
class Answers(InputPartition):
    """One group of rows of one file of answers."""

    path: str
    group: int


class FeedsReader(DataSourceReader):
    """Reads answers group by group, batch by batch; a batch is one of the file's, so no answer is held twice."""

    def __init__(self, options: dict):
        self.path, self.keys = options["path"], set(filter(None, options.get("keys", "").split(",")))
        self.modules = list(filter(None, options.get("modules", "").split(",")))

    def _store(self):
        from pyarrow import fs

        from .files import _local

        return _local(self.path) if _local(self.path) else fs.FileSystem.from_uri(self.path.replace("s3a://", "s3://", 1))

    def partitions(self) -> list[InputPartition]:
        """A partition for each group of rows of each Parquet file below the path; only footers are read."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = self._store()
        found = []
        for info in store.get_file_info(fs.FileSelector(path, recursive=True)):
            if info.is_file and info.path.endswith(".parquet"):
                with store.open_input_file(info.path) as f:
                    found += [Answers(info.path, g) for g in range(pq.ParquetFile(f).num_row_groups)]
        return found

    def read(self, partition: Answers) -> Iterator[pa.RecordBatch]:
        """The items of a partition."""
        import importlib

        import pyarrow.parquet as pq

        for m in self.modules:
            importlib.import_module(m)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        if partition is None or getattr(partition, "path", None) is None:
            return
        store, _ = self._store()
        with store.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(64, row_groups=[partition.group], columns=["source_id", "kind", "body"]):
                rows = [r for s, k, b in zip(*(batch.column(c).to_pylist() for c in ("source_id", "kind", "body")), strict=True) for r in rows_of(None if s is None else str(s), k, b, self.keys)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 3 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))], names=names)


class Feeds(DataSource):
    """Stored answers (Parquet: source_id, kind, body) as items. Options: path; keys, the kinds whose key is there; modules, which register more kinds."""

    @classmethod
    def name(cls) -> str:
        """What format() calls it."""
        return "feeds"

    def schema(self) -> str:
        """SCHEMA."""
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        """A reader of the options' path."""
        return FeedsReader(self.options)


def install(spark: SparkSession) -> None:
    """Make format("feeds") known to a session."""
    spark.dataSource.register(Feeds)
