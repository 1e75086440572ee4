"""Tag taxonomies: JSON of several shapes to node and edge tables, and a paged reader."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TAG = "struct<id:string,name:string,description:string,aliases:array<string>,parents:array<struct<id:string,name:string>>,children:array<struct<id:string,name:string>>>"


def tags_of(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Tags of payloads {data:{findTags:{tags}}}, {tags} or a bare list; another shape raises."""
    nested = F.from_json(column, f"data struct<findTags:struct<tags:array<{TAG}>>>, tags array<{TAG}>")
    bare = F.from_json(column, f"array<{TAG}>")
    tags = F.when(F.ltrim(F.col(column)).startswith("["), bare).otherwise(F.coalesce(nested["data"]["findTags"]["tags"], nested["tags"]))
    checked = F.coalesce(tags, F.raise_error(F.lit("a taxonomy holds data.findTags.tags, tags or a list")).cast(f"array<{TAG}>"))
    return payloads.select(F.explode(checked).alias("tag")).select("tag.*")


def nodes_and_edges(tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, name, description, aliases) and (child_id, parent_id, ord) from parents, joined by what children tell."""
    nodes = tags.select("id", "name", "description", "aliases")
    up = tags.select(F.col("id").alias("child_id"), F.posexplode("parents").alias("ord", "p")).select("child_id", F.col("p.id").alias("parent_id"), "ord")
    down = tags.select(F.col("id").alias("parent_id"), F.explode("children").alias("c")).select(F.col("c.id").alias("child_id"), "parent_id", F.lit(1_000_000).alias("ord"))
    return nodes, up.unionByName(down).groupBy("child_id", "parent_id").agg(F.min("ord").alias("ord"))


class PagedTags(DataSource):
    """Batch source of tags from a paged service: ``fetch(page, size)`` gives (tags, total); one partition a page.

    Options: total, size (500). Give the fetch function with ``paged_tags``.
    """

    fetch: Callable[[int, int], tuple[list[dict], int]]

    @classmethod
    def name(cls) -> str:
        return "paged_tags"

    def schema(self) -> str:
        return "id string, name string, description string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(type(self).fetch, int(self.options["total"]), int(self.options.get("size", 500)))


class _PageReader(DataSourceReader):
    def __init__(self, fetch, total: int, size: int):
        self.fetch, self.total, self.size = fetch, total, size

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(1, -(-self.total // self.size) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        tags, _ = self.fetch(partition.value, self.size)
        for t in tags:
            yield t["id"], t.get("name"), t.get("description")


def paged_tags(spark: SparkSession, fetch: Callable[[int, int], tuple[list[dict], int]], size: int = 500) -> DataFrame:
    """All pages of a tag service; the first call only asks for the total."""
    _, total = fetch(1, 1)
    source = type("PagedTagsOf", (PagedTags,), {"fetch": staticmethod(fetch)})
    spark.dataSource.register(source)
    return spark.read.format("paged_tags").option("total", total).option("size", size).load()
