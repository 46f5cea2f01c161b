"""A paged service as a Spark data source: one partition per page.

The transport is a function from (first row, last row) to a page's XML text, so that services, caches and tests differ
only in it. Result codes: ok, nothing published, or an error whose text hides the key.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_ROWS, OK, NOTHING = 1000, "INFO-000", "INFO-200"
_BETWEEN = "\x01"


class NotPublished(Exception):
    """The service has no such data yet."""


class ServiceError(Exception):
    """The service refused."""


def checked(text: str, key: str = "") -> ET.Element:
    """The document of a page, or the exception that its result code stands for. A page without a result is an error,
    because those that succeed have one."""
    root = ET.fromstring(text)
    result = root if root.tag == "RESULT" else root.find("RESULT")
    code = (result.findtext("CODE") or "").strip() if result is not None else ""
    if code == NOTHING:
        raise NotPublished(code)
    if code != OK:
        message = f"{code or 'no result'}: {result.findtext('MESSAGE') or '' if result is not None else ''}"
        raise ServiceError(message.replace(key, "***") if key else message)
    return root


def result_states(pages: DataFrame, xml: str = "xml", key: str = "") -> DataFrame:
    """Adds ``state`` (``ok``, ``not_published`` or ``error``) and ``message`` (without the key, empty where there is none) to
    rows of stored pages, by the result in the root or as the root."""
    # one look at each page: code and message come as one text, as a page can't hold the character between them
    one = lambda tag: f"/RESULT/{tag} | /*[name() != 'RESULT']/RESULT/{tag}"
    found = F.xpath_string(xml, F.lit(f"concat({one('CODE')}, '{_BETWEEN}', {one('MESSAGE')})"))
    rows = pages.withColumn("__found", F.split(found, _BETWEEN, 2))
    at = lambda i: F.trim(F.get("__found", F.lit(i)))
    state = F.when(at(0) == OK, "ok").when(at(0) == NOTHING, "not_published").otherwise("error")
    message = F.replace(at(1), F.lit(key), F.lit("***")) if key else at(1)
    return rows.withColumns({"state": state, "message": message}).drop("__found")


def page_rows(page: ET.Element, columns: dict[str, tuple[str, ...]]):
    """The rows of a page; ``columns`` maps each text column to the tags that may hold it, the first one that a row has counts."""
    for row in page.iter("row"):
        yield tuple(next((row.findtext(t) for t in tags if row.find(t) is not None), None) for tags in columns.values())


def stored_rows(pages: DataFrame, columns: dict[str, tuple[str, ...]], xml: str = "xml", key: str = "") -> DataFrame:
    """The rows of stored pages, as text columns. A page that isn't published has none; one with an error, or a null, fails."""
    schema = ", ".join(f"`{c}` string" for c in columns)

    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                try:
                    rows = list(page_rows(checked(text or "<none/>", key), columns))
                except NotPublished:
                    continue
                arrays = zip(*rows) if rows else [[] for _ in columns]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in arrays], list(columns))

    return pages.select(xml).mapInArrow(run, schema)


def page_source(name: str, fetch: Callable[[int, int], str], columns: dict[str, tuple[str, ...]], total: int, key: str = "") -> type[DataSource]:
    """A data source class; ``columns`` maps each text column to the tags that may hold it."""

    class Page(InputPartition):
        def __init__(self, first: int):
            super().__init__(first)
            self.first = first

    class Reader(DataSourceReader):
        def partitions(self):
            return [Page(i) for i in range(1, total + 1, PAGE_ROWS)] or [Page(1)]

        def read(self, partition):
            if total:
                yield from page_rows(checked(fetch(partition.first, min(total, partition.first + PAGE_ROWS - 1)), key), columns)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return ", ".join(f"`{c}` string" for c in columns)

        def reader(self, schema):
            return Reader()

    return Source


def read_pages(spark: SparkSession, source: type[DataSource]) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()


#: Suffixes of a route's variants in the listing: one letter, or commuter runs (fixed values).
VARIANT_SUFFIX = "([A-Z]|출근|퇴근)"


def route_variants(listed: DataFrame) -> DataFrame:
    """Variants of each route of a listing (``route``, ``name``): the exact name alone, as ``route``, or else each name
    that adds a variant's suffix, as ``route|name``. Repeated names count once; a route without either has no row."""
    names = listed.where("name is not null").distinct()
    suffix = F.expr("substring(name, length(route) + 1)")
    exact = names.where("name = route").select("route", "name", F.col("route").alias("variant"))
    more = names.where(F.startswith("name", "route") & suffix.rlike(f"^{VARIANT_SUFFIX}$")).select("route", "name", F.concat_ws("|", "route", "name").alias("variant"))
    return exact.unionByName(more.join(exact.select("route"), "route", "left_anti"))


def within_quota(routes: DataFrame, fetched: str, calls: int, quota: int) -> DataFrame:
    """The routes that a day's quota of calls covers, those fetched longest ago (or never) first; ties by name."""
    return routes.orderBy(F.col(fetched).asc_nulls_first(), "route").limit(quota // calls)
