"""Shared pieces: the folder all machines see, written tables, components of links."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: Spark (Java) pattern and DuckDB (RE2) pattern of what separates words.
GAP = r"[\x20\x09-\x0D]+"


_cache: dict = {"owner": None, "kept": {}}


def give_back() -> None:
    """Returns this process's freed memory to the system, where the C library can; allocators keep it otherwise, beside the next operator's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def kept_by(owner: str) -> dict:
    """What the operator keeps in this Python worker between tasks; another operator's is freed, so that memory is one operator's."""
    if _cache["owner"] != owner:
        _cache.update(owner=owner, kept={})
        give_back()
    return _cache["kept"]


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only in local mode (tests). A cluster without the setting is an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sequora-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected links (a, b), both of one type.

    Returns (node, component), component being the least node reachable. Alternating
    large-star and small-star rounds (Kiveris et al., 2014): every round is two shuffles of
    at most as many rows as there are links, nothing is gathered on the driver, and each
    round is cut by a written table. A node of many links is split by the partial minimum.
    """
    links = written(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), name)
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: each neighbour above a node points to the node's least neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: of the neighbours below a node, the others and the node point to the least
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least2 = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least2.select("a", F.col("m").alias("b"))).distinct()
        after = written(small, name)
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), after)]
        links = after
        if sums[0] == sums[1]:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
