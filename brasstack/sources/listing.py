"""A data source of the links on stored pages: spark.read.format("page_links").options(...).load(path).

A partition is a row group of the pages' Parquet files. What is asked for goes to the reader as options: from_page and
to_page leave out row groups by their statistics and rows before their HTML is parsed; scheme and hosts leave out rows
by their URL, and a row group without any such row is never read beyond its two narrow columns. Spark keeps one reader for
all plans over a loaded table, so filters that a reader learned from one plan would reach the next. This one therefore
learns none: it takes a pushed filter only if it is what its options already ask for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
)

SCHEMA = "page_id long, scheme string, host string, pos int, href string"
_TYPES = pa.schema([("page_id", pa.int64()), ("scheme", pa.string()), ("host", pa.string()), ("pos", pa.int32()), ("href", pa.string())])
_LINK = re.compile(r"""<a\s[^>]*?href="([^"]*)\"""")
_URL = re.compile(r"^([a-z]+)://([^/?#]+)")
#: Pages whose HTML is held at once.
PAGES = 256


@dataclass
class RowGroup(InputPartition):
    """One row group of one file."""

    path: str
    group: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class LinkReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.scheme = options["path"], options.get("scheme")
        self.hosts = frozenset(options["hosts"].split(",")) if options.get("hosts") else None
        self.low, self.high = (int(options[k]) if options.get(k) else None for k in ("from_page", "to_page"))

    def _applied(self, f: Filter) -> bool:
        """Whether every row that read() gives passes the filter."""
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column == "page_id":
            return (isinstance(f, GreaterThanOrEqual) and f.value == self.low) or (isinstance(f, LessThan) and f.value == self.high)
        if column == "scheme":
            return isinstance(f, EqualTo) and f.value == self.scheme
        if column == "host" and self.hosts:
            return self.hosts == (frozenset(f.value) if isinstance(f, In) else {f.value} if isinstance(f, EqualTo) else None)
        return False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return (f for f in filters if not self._applied(f))  # Spark applies what is given back

    def partitions(self) -> list[InputPartition]:
        system, root = _opened(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [root] if info.type == fs.FileType.File else sorted(
            x.path for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(".parquet"))
        out: list[InputPartition] = []
        for name in files:
            with system.open_input_file(name) as f:
                meta = pq.read_metadata(f)
            at = meta.schema.to_arrow_schema().get_field_index("page_id")
            for g in range(meta.num_row_groups):
                seen = meta.row_group(g).column(at).statistics
                known = seen is not None and seen.has_min_max
                if not (known and ((self.low is not None and seen.max < self.low) or (self.high is not None and seen.min >= self.high))):
                    out.append(RowGroup(name, g))
        return out or [RowGroup("", -1)]

    def _wanted(self, page, scheme, host) -> bool:
        if page is None and (self.low, self.high) != (None, None):
            return False
        return (self.low is None or page >= self.low) and (self.high is None or page < self.high) and self.scheme in (None, scheme) and (not self.hosts or host in self.hosts)

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        if partition.group < 0:
            return
        system, _ = _opened(self.path)
        with system.open_input_file(partition.path) as f:
            file = pq.ParquetFile(f)
            narrow = file.read_row_group(partition.group, columns=["page_id", "url"])
            heads = []
            for page, url in zip(narrow["page_id"].to_pylist(), narrow["url"].to_pylist(), strict=True):
                met = _URL.match(url or "")
                scheme, host = met.groups() if met else (None, None)
                heads.append((page, scheme, host) if self._wanted(page, scheme, host) else None)
            if not any(heads):
                return
            at = 0
            for batch in file.iter_batches(PAGES, row_groups=[partition.group], columns=["html"]):
                rows = []
                for head, text in zip(heads[at : at + batch.num_rows], batch["html"], strict=True):
                    if head:
                        rows += [(*head, pos, m[1]) for pos, m in enumerate(_LINK.finditer(text.as_py() or ""))]
                at += batch.num_rows
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _TYPES, strict=True)], schema=_TYPES)


class PageLinks(DataSource):
    """(page_id, scheme, host, pos, href): each link with a quoted address, in page order; scheme and host are the page's.

    Pages (page_id, url, html) are Parquet files below a path that pyarrow can open. Null HTML has no links; a URL that
    isn't absolute has neither scheme nor host.
    """

    @classmethod
    def name(cls) -> str:
        return "page_links"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LinkReader:
        return LinkReader(self.options)


def page_links(spark: SparkSession, path: str, scheme: str | None = None, hosts: list[str] | None = None, from_page: int | None = None, to_page: int | None = None) -> DataFrame:
    """The links of pages of a scheme, of hosts, and of ids from from_page to below to_page."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageLinks)
    asked = {"scheme": scheme, "hosts": ",".join(hosts) if hosts else None, "from_page": from_page, "to_page": to_page}
    out = spark.read.format("page_links").options(**{k: str(v) for k, v in asked.items() if v is not None}).load(path)
    for value, test in ((scheme, F.col("scheme") == scheme), (hosts, F.col("host").isin(hosts or [])), (from_page, F.col("page_id") >= from_page), (to_page, F.col("page_id") < to_page)):
        out = out if value is None else out.filter(test)
    return out
