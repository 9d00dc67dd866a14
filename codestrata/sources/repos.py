"""Repository metadata and listings from landed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import QA_EXTS, ext_of

# Shape of the landed records, listing limits.
REPO_SCHEMA = (
    "name string, full_name string, description string, language string, languages_url string, stargazers_count bigint, "
    "forks_count bigint, size bigint, created_at timestamp, updated_at timestamp, default_branch string, topics array<string>, "
    "license struct<name:string>, html_url string, clone_url string"
)
LISTING_SCHEMA = "repo string, type string, path string, name string, size bigint, download_url string"
MAX_LISTED, LARGE_REPOSITORY, POPULAR = 100, 100, 10
COUNTED_SUFFIXES = r"\.(?:py|js|ts)$"


def read_repositories(spark: SparkSession, path: str) -> DataFrame:
    return repository_metadata(spark.read.schema(REPO_SCHEMA).json(path))


def parse_repositories(rows: DataFrame, column: str = "value") -> DataFrame:
    """The same from a column of JSON texts."""
    return repository_metadata(rows.select(F.from_json(column, REPO_SCHEMA).alias("r")).select("r.*"))


def repository_metadata(raw: DataFrame) -> DataFrame:
    """Fourteen scalar fields and the topics, with the usual defaults for missing values."""
    def default(c: str, value: Column) -> Column:
        return F.coalesce(F.col(c), value)

    return raw.select(
        "name", "full_name", "description", "language", F.col("languages_url").alias("languages"),
        default("stargazers_count", F.lit(0)).alias("stars"), default("forks_count", F.lit(0)).alias("forks"),
        default("size", F.lit(0)).alias("size"), "created_at", "updated_at",
        default("default_branch", F.lit("main")).alias("default_branch"),
        default("topics", F.array().cast("array<string>")).alias("topics"), F.col("license.name").alias("license"),
        F.col("html_url").alias("url"), "clone_url",
    )


def list_files(listing: DataFrame, max_files: int = MAX_LISTED) -> DataFrame:
    """Code and document files of every repository, the first ``max_files`` in path order."""
    wanted = listing.where((F.col("type") == "file") & F.lower(ext_of(F.col("name"))).isin(QA_EXTS))
    order = Window.partitionBy("repo").orderBy("path")
    return wanted.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max_files).drop("rn", "type")


def supported_counts(listing: DataFrame) -> DataFrame:
    """Files the analysis covers per repository, and whether that makes it a large one."""
    counted = F.count_if((F.col("type") == "file") & F.col("name").rlike(COUNTED_SUFFIXES))
    return listing.groupBy("repo").agg(counted.alias("supported_files")).withColumn("large", F.col("supported_files") > LARGE_REPOSITORY)


def popular(repos: DataFrame, query: str = "python", n: int = POPULAR) -> DataFrame:
    """Most starred Python repositories that match the query in name or description."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower("full_name"), q) | F.contains(F.lower(F.coalesce("description", F.lit(""))), q)
    return (
        repos.where((F.lower("language") == "python") & hit)
        .orderBy(F.desc("stars"), "full_name")
        .limit(n)
        .select("name", "full_name", "description", "stars", "language", "url", "clone_url")
    )


def parse_url(url: Column, host: str = "github.com") -> Column:
    """Owner, name and cleaned address of a repository URL, or null when it has no owner and name."""
    clean = F.replace(url, F.lit(".git"), F.lit(""))
    path = F.regexp_extract(clean, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    parts = F.split(F.btrim(path, F.lit("/")), "/")
    return F.when(
        F.contains(url, F.lit(host)) & (F.size(parts) >= 2),
        F.struct(F.get(parts, F.lit(0)).alias("owner"), F.get(parts, F.lit(1)).alias("name"), clean.alias("url")),
    )


def split_branch(path: Column) -> Column:
    """``url@branch`` into its parts; no branch means main."""
    parts = F.split(path, "@")
    return F.struct(
        F.get(parts, F.lit(0)).alias("url"), F.coalesce(F.get(parts, F.lit(1)), F.lit("main")).alias("branch")
    )
