"""Lists of repositories: links as text, landed search results, ground truth, and where a repository lies on disk."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How search results are cut.
PER_LANGUAGE, LEAST_STARS, LEAST_KB, MOST_KB = 20, 100, 10_000, 20_000
BLACKLIST = ["awesome", "tutorial", "example", "demo", "boilerplate", "starter", "template", "learning", "course", "sample"]

GROUND_TRUTH = "repo_full_name string, vulnerable_commit string, patched_commit string, cves array<string>, ground_truth_label string, pr_url string, closed_at string, merged_at string"


def full_name(link: Column) -> Column:
    """owner/name of a link or of an owner/name text, without .git, @commit and trailing slashes; null if it is neither."""
    clean = F.regexp_replace(F.trim(link), r"(\.git)?/*$", "")
    return F.nullif(F.regexp_extract(clean, r"^(?:(?:https?://|git@)[^/:]+[/:])?([\w.-]+/[\w.-]+?)(?:\.git)?(?:@\w+)?$", 1), F.lit(""))


def blacklisted(text: Column) -> Column:
    """Whether a name or description says that a repository is no software of its own."""
    low, named = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for word in BLACKLIST:
        named = named | F.contains(low, F.lit(word))
    return named


def repository_url(url: Column) -> Column:
    """A repository's https address without trailing slashes, '' if it is none of the known host."""
    clean = F.translate(F.trim(url), "\\", "/")
    return F.when(F.startswith(F.lower(clean), F.lit("https://github.com/")), F.regexp_replace(clean, "/+$", "")).otherwise("")


def looked_up(names: DataFrame, repos: DataFrame) -> DataFrame:
    """``names`` (name) with the repository they mean: by its key, else by its full name, else by that in any case.

    ``repos`` (metadata_key, full_name).  Names that mean none are left out.
    """
    one = lambda key, k: repos.filter(key.isNotNull() & (key != "")).groupBy(key.alias(f"_k{k}")).agg(F.max("full_name").alias(f"_f{k}"))
    by = [(F.col("metadata_key"), F.col("name")), (F.col("full_name"), F.col("name")), (F.lower("full_name"), F.lower("name"))]
    out = names
    for k, (key, name) in enumerate(by):
        out = out.join(one(key, k), name == F.col(f"_k{k}"), "left")
    return out.withColumn("full_name", F.coalesce("_f0", "_f1", "_f2")).filter("full_name IS NOT NULL").select(*names.columns, "full_name")


def catalogue(projects: DataFrame) -> DataFrame:
    """The list of projects, by name."""
    return projects.select("project", F.coalesce("language", F.lit("Unknown")).alias("language"), "package_manager").distinct().orderBy("project")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(full_name, link): lines of a text file; comments and blank lines are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("link")).filter("link <> '' AND NOT startswith(link, '#')")
    return lines.select(full_name(F.col("link")).alias("full_name"), "link").filter("full_name IS NOT NULL")


def canonical_project(name: Column) -> Column:
    """A project's name without its commit."""
    return F.trim(F.split(name, "@")[0])


def searched(repos: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The most starred repositories of each language within the size and star limits; (full_name, language, stars, size_kb)."""
    fit = repos.filter((F.col("stars") >= LEAST_STARS) & F.col("size_kb").between(LEAST_KB, MOST_KB) & ~blacklisted(F.col("full_name")))
    order = Window.partitionBy("language").orderBy(F.desc("stars"), "full_name")
    return fit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language)


def pending(ground_truth: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """Ground-truth entries whose (repo_full_name, vulnerable_commit) is not in ``done``, in order, at most ``most``."""
    left = ground_truth.join(done, ["repo_full_name", "vulnerable_commit"], "left_anti").orderBy("repo_full_name", "vulnerable_commit")
    return left if most is None else left.limit(most)


# Names of languages that one flow covers, and states of a clone that can be worked on.
FLOWS = {"python": ["python", "py"], "nodejs": ["javascript", "js", "typescript", "ts"]}
CLONED = ["success", "already_exists", "updated"]


def ready(repos: DataFrame, done: DataFrame, flow: str | None = None, states: list[str] = CLONED[:2]) -> DataFrame:
    """Repositories (full_name, language, clone_status) that are cloned, of the flow's languages, and not in ``done`` (full_name)."""
    fit = repos.filter(F.col("clone_status").isin(states) & (F.coalesce("full_name", F.lit("")) != ""))
    if flow is not None:
        fit = fit.filter(F.lower(F.trim(F.coalesce("language", F.lit("")))).isin(FLOWS["python" if flow == "python" else "nodejs"]))
    return fit.join(done.select("full_name").distinct(), "full_name", "left_anti").select(*repos.columns)


def path_index(*indexes: DataFrame) -> DataFrame:
    """(full_name, path) from several indexes; the first that knows a repository counts."""
    both = None
    for k, df in enumerate(indexes):
        one = df.select("full_name", "path", F.lit(k).alias("k"))
        both = one if both is None else both.unionByName(one)
    return both.groupBy("full_name").agg(F.min_by("path", F.struct("k", "path")).alias("path"))


def inside_tree(path: Column) -> Column:
    """Whether a path stays in the tree it is relative to."""
    clean = F.translate(path, "\\", "/")
    return ~F.array_contains(F.split(clean, "/"), "..") & ~F.startswith(clean, F.lit("/")) & ~clean.rlike("^[A-Za-z]:")


def read_sources(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """(path, number, text): numbered lines of the files under a folder, paths relative to it.

    A file is read whole by one task (files are dealt out by size), so numbers need no shuffle and a long line stays whole.
    Line ends are those of any system; a last line without text is none.  Hidden files are left out.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().toString().rstrip("/")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    tail = F.substring(path, F.lit(1) + F.length(F.regexp_extract(path, "^.*?" + re.escape(re.sub("^[a-z]+:/*", "", unquote(root))) + "/", 0)), F.lit(1 << 20))
    lines = F.split("value", r"\r\n|\n|\r")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    numbered = files.select(tail.alias("path"), F.posexplode(lines).alias("k", "text"))
    return numbered.select("path", (F.col("k") + 1).cast("long").alias("number"), "text")


def snippets(lines: DataFrame, locations: DataFrame, radius: int = 3) -> DataFrame:
    """(path, line, snippet): numbered source lines around each location, the focus marked.

    ``lines`` (path, number, text), ``locations`` (path, line).  A line meets a location by an equi-join on path and
    one on the block of lines it lies in, so a long file does not meet all of its locations.  Paths that leave the tree are dropped.
    """
    width = 2 * radius + 1
    wanted = locations.filter(inside_tree(F.col("path"))).distinct()
    first, last = F.floor((F.col("line") - radius) / width), F.floor((F.col("line") + radius) / width)
    blocks = wanted.select("path", "line", F.explode(F.sequence(first, last)).alias("block"))
    met = lines.withColumn("block", F.floor(F.col("number") / width)).join(blocks, ["path", "block"]).filter(F.abs(F.col("number") - F.col("line")) <= radius)
    shown = F.concat(F.when(F.col("number") == F.col("line"), ">> ").otherwise("   "), F.col("number").cast("string"), F.lit(": "), "text")
    return met.groupBy("path", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", shown.alias("s")))), lambda x: x["s"]), "\n").alias("snippet"))
