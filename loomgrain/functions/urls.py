"""Host functions of web sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrain.operators.ordering import numbered

# Parts of host names of stock sites, and of content delivery networks.
STOCK = (
    "shutterstock.com", "gettyimages.com", "istockphoto.com", "alamy.com", "dreamstime.com", "123rf.com",
    "depositphotos.com", "vectorstock.com", "bigstockphoto.com", "canstockphoto.com", "adobestock.com", "stock.adobe.com",
)
CDN = (
    "wp.com", "wordpress.com", "cloudinary.com", "imgix.net", "fastly.net", "cloudfront.net", "akamaized.net",
    "googleusercontent.com", "ytimg.com", "twimg.com", "fbcdn.net", "cdninstagram.com", "pinimg.com", "media.tumblr.com",
    "staticflickr.com", "ggpht.com", "redd.it", "imgur.com", "deviantart.net", "wikimedia.org",
)


def host(url: Column) -> Column:
    """Host with port; ``unknown`` if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")), F.lit("unknown"))


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    return c.rlike("|".join(p.replace(".", r"\.") for p in parts))


def is_blocked(h: Column) -> Column:
    """F8."""
    return _any(h, STOCK)


def is_cdn(h: Column) -> Column:
    """F9."""
    return _any(h, CDN)


def is_irrelevant(h: Column, domains: tuple[str, ...] = ()) -> Column:
    """F10's predicate; without domains nothing is irrelevant."""
    return _any(F.lower(h), domains) if domains else F.lit(False)


def relevant_pages(urls: DataFrame, page: str, url: str, domains: tuple[str, ...] = (), most: float = 0.5) -> DataFrame:
    """the pages of which less than ``most`` of the URLs are irrelevant."""
    share = urls.groupBy(page).agg(F.avg(is_irrelevant(host(F.col(url)), domains).cast("int")).alias("share"))
    return share.where(F.col("share") < most).select(page)


def download_plan(urls: DataFrame, url: str, order: str, per_host: int = 4) -> DataFrame:
    """URLs without blocked hosts, ``per_host`` of each host (three times as many of a CDN), CDN first.

    Adds host, is_cdn, pos, the rank within the host by ``order``, and place, the rank in the plan: by CDN, pos, host and ``order`` (unique).
    """
    h = host(F.col(url))
    x = urls.where(F.col(url).isNotNull()).withColumn("host", h).where(~is_blocked(F.col("host"))).withColumn("is_cdn", is_cdn(F.col("host")))
    x = x.withColumn("pos", F.row_number().over(W.partitionBy("host").orderBy(order)))
    x = x.where(F.col("pos") <= 3 * per_host)  # a constant: the ranking of a host keeps no more rows than that
    x = x.where(F.col("is_cdn") | (F.col("pos") <= per_host))
    return numbered(x, [F.col("is_cdn").desc(), F.col("pos").asc(), F.col("host").asc(), F.col(order).asc()], "place", name="plan")


def target_file(url: Column) -> Column:
    """The file name of a download."""
    return F.concat(F.md5(url), F.lit(".jpg"))
