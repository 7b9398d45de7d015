"""A paged source as a Python data source: one partition per page, filters on equality handed to the server."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition


class Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


def paged(name: str, schema: str, count: Callable[[dict], int], fetch: Callable[[dict, int, int], list[tuple]], filters: tuple[str, ...] = ()):
    """A DataSource class to register. count(equals) gives the number of rows, fetch(equals, offset, limit) one page as
    tuples in a stable order; equals holds the pushed filters, on the columns named in `filters`."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.size, self.equals = int(options.get("page_size", 1000)), {}

        def pushFilters(self, found: list[Filter]) -> Iterator[Filter]:
            for f in found:
                if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in filters:
                    self.equals[f.attribute[0]] = f.value
                else:
                    yield f

        def partitions(self):
            return [Page(o, self.size) for o in range(0, count(self.equals), self.size)] or [Page(0, 0)]

        def read(self, partition):
            yield from fetch(self.equals, partition.offset, partition.limit) if partition.limit else ()

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

    return Source
