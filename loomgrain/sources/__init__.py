"""Sources: settings, prompt plans, images, result pages, search, downloads and indexes."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgrain import schemas
from loomgrain.functions.urls import target_file
from loomgrain.providers import Fetch, Search
from loomgrain.runtime import pandas_map

# Characters of a page that is no challenge, links of a result page.
SHORTEST_PAGE = 8000
PAGE = 57


def settings(path: str, env: dict[str, str] | None = None) -> dict:
    """A YAML file of settings; keys of services come from the environment, path settings become absolute."""
    import yaml

    env = os.environ if env is None else env
    with open(path, encoding="utf-8") as f:
        out = yaml.safe_load(f) or {}
    for service in ("bing", "qwen"):
        key = env.get(f"{service.upper()}_API_KEY")
        if key:
            out.setdefault(service, {})["api_key"] = key
    base = os.path.dirname(os.path.abspath(path))
    for k, v in (out.get("paths") or {}).items():
        if isinstance(v, str):
            out["paths"][k] = os.path.normpath(os.path.join(base, v))
    return out


def topics(spark: SparkSession, config: dict) -> DataFrame:
    """S2's input: one row per topic with its seed queries."""
    rows = [(t.get("name"), t.get("seed_queries") or []) for t in config.get("topics", [])]
    return spark.createDataFrame(rows, "topic string, seed_queries array<string>")


class _Pages(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self) -> list[InputPartition]:
        pages = -(-int(self.o.get("max_images", 200)) // int(self.o.get("size", PAGE)))
        return [InputPartition((q, p)) for q in self.o["queries"].split("\n") if q for p in range(pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        query, page = partition.value
        size = int(self.o.get("size", PAGE))
        module, name = self.o["provider"].rsplit(".", 1)
        provider: Search = getattr(importlib.import_module(module), name)()
        for i, url in enumerate(provider.page(query, page * size, size)):
            yield query, page * size + i, url


class SearchSource(DataSource):
    """S3 as a data source: one partition per query and page; options queries (one per line), provider, size, max_images."""

    @classmethod
    def name(cls) -> str:
        return "image_search"

    def schema(self) -> str:
        return "query string, pos int, url string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(dict(self.options))


def searched(spark: SparkSession, queries: list[str], provider: str, max_images: int = 200, size: int = PAGE) -> DataFrame:
    """The first ``max_images`` URLs of each query, in order of position, each once."""
    spark.dataSource.register(SearchSource)
    x = spark.read.format("image_search").options(queries="\n".join(queries), provider=provider, size=str(size), max_images=str(max_images)).load()
    first = x.groupBy("query", "url").agg(F.min("pos").alias("pos"))
    return first.where(F.col("pos") < max_images)


def image_links(html: Column) -> Column:
    """Image URLs of a result page: ``murl``, else ``turl``, of the JSON in the tags' attribute; else of bare ``murl`` text."""
    tag = F.regexp_extract_all(html, F.lit(r'(?s)class="[^"]*iusc[^"]*"[^>]*?\sm="([^"]*)"'), 1)
    meta = F.transform(tag, lambda m: F.replace(F.replace(m, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")))
    links = F.transform(meta, lambda j: F.coalesce(F.get_json_object(j, "$.murl"), F.get_json_object(j, "$.turl")))
    good = F.filter(links, lambda u: u.startswith("http"))
    bare = F.filter(F.regexp_extract_all(html, F.lit(r'"murl"\s*:\s*"(http[^"]+)"'), 1), lambda u: u.isNotNull())
    return F.array_distinct(F.when(F.size(good) > 0, good).otherwise(bare))


def is_real_page(html: Column) -> Column:
    """Shorter pages are challenges."""
    return F.coalesce(F.length(html) >= SHORTEST_PAGE, F.lit(False))


def page_stats(pages: DataFrame) -> DataFrame:
    """Pages, share of challenges, mean number of links."""
    n = F.count(F.lit(1))
    return pages.agg(n.alias("pages"), F.avg((~is_real_page(F.col("html"))).cast("int")).alias("challenge_share"), F.avg(F.size(image_links(F.col("html")))).alias("links_per_page"))


def downloaded(urls: DataFrame, have: DataFrame, provider: Fetch, least: int = 1024) -> DataFrame:
    """(url, file, content, error) of the URLs whose file is not in ``have`` yet; too small or other content is an error."""
    todo = urls.select("url").where(F.col("url").isNotNull()).distinct().withColumn("file", target_file(F.col("url"))).join(have.select("file"), "file", "left_anti")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file, url in zip(b["file"], b["url"]):
                try:
                    kind, data = provider.get(url)
                    bad = "content_type" if "image" not in kind else "too_small" if len(data) < least else None
                    out.append((url, file, None if bad else data, bad))
                except Exception as e:
                    out.append((url, file, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["url", "file", "content", "error"])

    return pandas_map(todo, fetch, "url string, file string, content binary, error string")


def dry_run(spark: SparkSession, query: str, n: int) -> DataFrame:
    """Made-up URLs with their file names."""
    url = F.concat(F.lit(f"dry://{query}/"), F.col("id").cast("string"))
    return spark.range(n).select(url.alias("url"), F.concat(F.sha1(url), F.lit(".jpg")).alias("file"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image structs with ``path`` and ``is_corrupt``."""
    x = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    return x.select(F.col("image.origin").alias("path"), "image", (F.col("image.height") < 0).alias("is_corrupt"))


def prompt_plans(spark: SparkSession, path: str) -> DataFrame:
    """Prompts of all JSON files below ``path``; unreadable files and blank prompts are left out."""
    x = spark.read.schema(schemas.record("prompt_plan")).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").json(path)
    return x.where(F.trim("prompt") != "")


def hash_index(spark: SparkSession, path: str) -> DataFrame:
    """A written index; reserved paths (``__*``) are left out."""
    return spark.read.schema(schemas.record("hash_index")).parquet(path).where(~F.col("path").startswith("__"))


def or_empty(spark: SparkSession, path: str, record: str) -> DataFrame:
    """A table of ours, or an empty one of its type if it is not there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    schema = schemas.record(record)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def next_number(names: DataFrame, column: str = "file") -> int:
    """One more than the greatest number in file names such as img_0000012."""
    n = names.select(F.max(F.regexp_extract(column, r"(\d+)", 1).try_cast("bigint"))).first()[0]
    return (n or 0) + 1
