"""Readers: driver tables, FASTA and match reports, and the sequence tables derived from driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

MATCHES = StructType([StructField("qseqid", StringType()), StructField("pident", DoubleType()), *(StructField(c, IntegerType()) for c in ("length", "qstart", "qend", "sstart", "send")), StructField("evalue", DoubleType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(acc, seq) of a FASTA file; acc is the header up to the first blank."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.substr(F.col("value"), F.length(head) + 2)
    return records.select(F.regexp_extract(F.trim(head), r"^\S+", 0).alias("acc"), F.regexp_replace(body, r"\s+", "").alias("seq"))


def single_record(sequences: DataFrame) -> DataFrame:
    """The sequences, if there is exactly one; else ValueError."""
    n = len(sequences.limit(2).select("acc").collect())
    if n != 1:
        raise ValueError("exactly one sequence is needed" if n else "no sequence found")
    return sequences


def match_report(spark: SparkSession, path: str) -> DataFrame:
    """A headerless match report of eight columns; an empty one is an error."""
    rows = spark.read.csv(path, schema=MATCHES)
    if rows.isEmpty():
        raise ValueError("the match report is empty")
    return rows


def separator(line: str) -> str:
    """The one of , ; and tab that cuts the line into most fields."""
    best = max(",;\t", key=lambda s: len(line.split(s)))
    if len(line.split(best)) < 2:
        raise ValueError("no separator found")
    return best


def taxonomy_text(spark: SparkSession, path: str) -> DataFrame:
    """(acc, names): first field and last three of lines with any number of fields."""
    lines = spark.read.text(path)
    sep = separator(lines.first()[0])
    parts = F.split("value", f"[{sep}]")
    return lines.select(parts[0].alias("acc"), F.slice(parts, -3, 3).alias("names"))


def taxdump(spark: SparkSession, names_path: str, nodes_path: str) -> tuple[DataFrame, DataFrame]:
    """(names, nodes) of a taxonomy dump, scientific names only, with TaxId 0 for unknown."""
    bar = r"\t\|\t?"

    def rows(path):
        return spark.read.text(path).select(F.split("value", bar).alias("f"))

    names = rows(names_path).where(F.col("f")[3] == "scientific name").select(F.col("f")[0].cast("bigint").alias("taxid"), F.col("f")[1].alias("name"))
    nodes = rows(nodes_path).select(F.col("f")[0].cast("bigint").alias("taxid"), F.col("f")[1].cast("bigint").alias("parent"), F.col("f")[2].alias("rank"))
    return names.union(spark.createDataFrame([(0, "Unknown")], names.schema)), nodes.union(spark.createDataFrame([(0, 1, "no rank")], nodes.schema))


def with_source(spark: SparkSession, path: str) -> DataFrame:
    """Lines of many files with the taxon and marker that the file names (taxon_marker.ext) give."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return spark.read.text(path).select("value", F.regexp_extract(name, r"^(.+?)_", 1).alias("taxon"), F.regexp_extract(name, r"_([^_.]+)\.", 1).alias("marker"))


def code_of(v: Column) -> Column:
    """Five classes of a number: 0 stands for a missing value."""
    return F.when(F.abs(v) < 0.01, 0).when(v < -0.085, 1).when(v < 0, 2).when(v < 0.085, 3).otherwise(4)


def cells(spark: SparkSession, sf_dir: str, n_sites: int | None = None) -> DataFrame:
    """(seq, site, code, label), a row per value of every embedding, or of its first sites."""
    e = table(spark, sf_dir, "embeddings")
    values = F.col("embedding") if n_sites is None else F.slice("embedding", 1, n_sites)
    long = e.select(F.col("vec_id").cast("bigint").alias("seq"), F.col("label").cast("bigint").alias("label"), F.posexplode(values).alias("site", "v"))
    return long.select("seq", "site", code_of(F.col("v").cast("double")).alias("code"), "label")


def alignment(spark: SparkSession, sf_dir: str, n_sites: int | None = None) -> DataFrame:
    """(seq, codes, label): the same as one array per sequence."""
    e = table(spark, sf_dir, "embeddings")
    values = F.col("embedding") if n_sites is None else F.slice("embedding", 1, n_sites)
    return e.select(F.col("vec_id").cast("bigint").alias("seq"), F.transform(values, lambda v: code_of(v.cast("double"))).alias("codes"), F.col("label").cast("bigint").alias("label"))


def genus() -> Column:
    return F.when(F.col("seq") % 17 != 0, 100 + F.col("label")).cast("bigint")


def lineage(sequences: DataFrame) -> DataFrame:
    """(seq, order, family, genus) from labels; every 17th genus is unknown (null)."""
    return sequences.select("seq", (1 + F.floor(F.col("label") / 6)).cast("bigint").alias("order"), (10 + F.floor(F.col("label") / 2)).cast("bigint").alias("family"), genus().alias("genus"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(taxid, parent, rank): root 1, regions, nations and customers as one tree."""
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    root = spark.range(1).select(F.lit(1).cast("bigint").alias("taxid"), F.lit(1).cast("bigint").alias("parent"), F.lit("root").alias("rank"))
    regions = r.select((10 + F.col("r_regionkey")).cast("bigint"), F.lit(1).cast("bigint"), F.lit("region"))
    nations = n.select((100 + F.col("n_nationkey")).cast("bigint"), (10 + F.col("n_regionkey")).cast("bigint"), F.lit("nation"))
    customers = c.select((100000 + F.col("c_custkey")).cast("bigint"), (100 + F.col("c_nationkey")).cast("bigint"), F.lit("customer"))
    return root.union(regions).union(nations).union(customers)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qseqid, sstart, send, evalue) as a match report gives them: reversed where send < sstart."""
    li = table(spark, sf_dir, "lineitem")
    a = F.col("l_quantity").cast("int")
    b = (F.col("l_quantity") + F.col("l_linenumber") * 3).cast("int")
    even = F.col("l_linenumber") % 2 == 0
    return li.select(F.col("l_orderkey").cast("bigint").alias("qseqid"), F.col("l_linenumber").cast("bigint").alias("line"), F.when(even, b).otherwise(a).alias("sstart"), F.when(even, a).otherwise(b).alias("send"), (F.col("l_discount") / 10).alias("evalue"))


def wide_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(acc, family, genus, species): names that nest, from the parts."""
    p = table(spark, sf_dir, "part")
    family = F.col("p_type")
    genus = F.concat_ws("|", "p_type", "p_brand")
    return p.select(F.col("p_partkey").cast("bigint").alias("acc"), family.alias("family"), genus.alias("genus"), F.concat_ws("|", genus, "p_name").alias("species"))


def last_first(df: DataFrame, by: list, order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")
