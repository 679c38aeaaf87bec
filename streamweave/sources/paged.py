"""A batch source over a paged service: the pages are the partitions.

The fetch function is a parameter (offset, size) -> list of dicts, so the source
serves any paged interface; retries with linear back-off are part of the reader.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from streamweave.operators.checks import count_gap
from streamweave.operators.lineage import cut_lineage


class Page(InputPartition):
    def __init__(self, offset: int, size: int):
        self.offset, self.size = offset, size


def fetch_with_retry(fetch: Callable[[int, int], list[dict]], offset: int, size: int, attempts: int, pause: float) -> list[dict]:
    """Try a page up to `attempts` times, waiting longer each time; the last failure raises."""
    for attempt in range(1, attempts + 1):
        try:
            return fetch(offset, size)
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(pause * attempt)
    return []


def page_size_of(wanted: int, server_most: int | None) -> int:
    """The page size to ask for: no more than the service gives at once."""
    return wanted if not server_most else min(wanted, server_most)


def find_total(fetch: Callable[[int, int], list[dict]], page_size: int, attempts: int = 3, pause: float = 1.0) -> int:
    """Rows of a service that doesn't tell its total: up to the first short page.

    Pages are probed at doubling distance and then by halving, so of n pages only
    2 log2(n) are fetched here and the rest by the tasks.
    """
    size = lambda page: len(fetch_with_retry(fetch, page * page_size, page_size, attempts, pause))
    full, far = -1, 0  # page `full` is known to be full, page `far` is probed
    while (n := size(far)) == page_size:
        full, far = far, 2 * far + 1
    last = n
    while far - full > 1:
        middle = (full + far) // 2
        n = size(middle)
        if n == page_size:
            full = middle
        else:
            far, last = middle, n
    return far * page_size + last


def read_until_short(spark: SparkSession, fetch: Callable[[int, int], list[dict]], page_size: int, schema: str, server_most: int | None = None, attempts: int = 3, pause: float = 1.0, name: str = "paged_until_short") -> DataFrame:
    """Rows of all pages up to the first short one."""
    step = page_size_of(page_size, server_most)
    return read_pages(spark, fetch, find_total(fetch, step, attempts, pause), step, schema, attempts, pause, name)


def read_service(spark: SparkSession, describe: Callable[[], dict], fetch: Callable[[int, int], list[dict]], schema: str, most: str = "maxRecordCount", count: str = "count", usual: int = 1000, attempts: int = 3, pause: float = 1.0, name: str = "paged_service") -> DataFrame:
    """All rows of a service that describes itself; each page is fetched once, as the result is written.

    `describe` gives the service's own limit of rows a page (`most`; asking for more
    would skip rows unnoticed; `usual` if it tells none) and how many rows there are
    (`count`).  If another number arrives, a warning tells both.
    """
    told = describe()
    step, expected = int(told.get(most) or usual), int(told[count])
    rows = cut_lineage(read_pages(spark, fetch, expected, step, schema, attempts, pause, name))
    if gap := count_gap(rows, expected):
        warnings.warn(f"received {expected - gap} rows of {expected}", stacklevel=2)
    return rows


def read_pages(spark: SparkSession, fetch: Callable[[int, int], list[dict]], total: int, page_size: int, schema: str, attempts: int = 3, pause: float = 1.0, name: str = "paged") -> DataFrame:
    """Rows of all pages; a page is one task, and only the named fields are kept."""

    class Reader(DataSourceReader):
        def __init__(self, fields):
            self.fields = fields

        def partitions(self):
            return [Page(at, min(page_size, total - at)) for at in range(0, total, page_size)] or [Page(0, 0)]

        def read(self, partition):
            if partition.size:
                for row in fetch_with_retry(fetch, partition.offset, partition.size, attempts, pause):
                    yield tuple(row.get(f) for f in self.fields)

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader([f.name for f in schema.fields])

    spark.dataSource.register(Paged)
    return spark.read.format(name).load()
