"""Spark data sources: slides by path, and pages of a remote file query."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .readers import OpenSlideReader, Synthetic, TiffSlideReader

READERS = {"synthetic": Synthetic, "openslide": OpenSlideReader, "tiffslide": TiffSlideReader}


class _Part(InputPartition):
    def __init__(self, items: list):
        self.items = items


class _SlideReader(DataSourceReader):
    def __init__(self, paths: list[str], kind: str, parts: int):
        self.paths, self.kind, self.parts = paths, kind, parts

    def pushFilters(self, filters: list) -> Iterator:
        """``path =`` and ``path in`` choose the slides to open; other filters are Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("path",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = [p for p in self.paths if p in wanted]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.parts, len(self.paths)))
        return [_Part(self.paths[i::n]) for i in range(n)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path in partition.items:
            reader = READERS[self.kind]()
            reader.open(path)
            try:
                p = reader.properties()
                yield path, p["width"], p["height"], p["mpp"], p["vendor"], [
                    (lv["level"], lv["width"], lv["height"], lv["downsample"]) for lv in p["levels"]
                ]
            finally:
                reader.close()


class Slides(DataSource):
    """``format("slides")`` with ``paths`` (a JSON list), ``reader`` and ``parts``."""

    @classmethod
    def name(cls) -> str:
        return "slides"

    def schema(self) -> str:
        return "path string, width int, height int, mpp double, vendor string, levels array<struct<level:int,width:int,height:int,downsample:double>>"

    def reader(self, schema) -> DataSourceReader:
        return _SlideReader(json.loads(self.options["paths"]), self.options.get("reader", "synthetic"), int(self.options.get("parts", 8)))


class _HitReader(DataSourceReader):
    def __init__(self, url: str, filters: str, size: int):
        self.url, self.filters, self.size = url, filters, size

    def _page(self, start: int, size: int) -> dict:
        from urllib.parse import urlencode
        from urllib.request import urlopen

        if "://" not in self.url:
            with open(self.url) as f:
                data = json.load(f)["data"]
            return {"hits": data["hits"][start : start + size], "pagination": {"total": len(data["hits"])}}
        q = urlencode(
            {
                "filters": self.filters, "fields": "file_id,file_name,file_size,md5sum,state,cases.project.project_id", "format": "JSON",
                "from": start, "size": size,
            }
        )
        with urlopen(f"{self.url}?{q}", timeout=120) as r:
            return json.load(r)["data"]

    def partitions(self) -> list[InputPartition]:
        total = self._page(0, 1)["pagination"]["total"]
        return [_Part([start]) for start in range(0, total, self.size)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for start in partition.items:
            for h in self._page(start, self.size)["hits"]:
                cases = [((c.get("project", {}).get("project_id"),),) for c in h.get("cases") or []]
                yield h.get("file_id"), h.get("file_name"), h.get("file_size"), h.get("md5sum"), h.get("state"), cases


class FileHits(DataSource):
    """``format("file_hits")``: one partition for each page of a file query.

    Options: ``url`` (or a JSON file of one answer), ``filters`` (JSON), ``size`` of a page.
    """

    @classmethod
    def name(cls) -> str:
        return "file_hits"

    def schema(self) -> str:
        return "file_id string, file_name string, file_size long, md5sum string, state string, cases array<struct<project:struct<project_id:string>>>"

    def reader(self, schema) -> DataSourceReader:
        return _HitReader(self.options["url"], self.options.get("filters", "{}"), int(self.options.get("size", 10000)))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in (Slides, FileHits):
        spark.dataSource.register(s)
