"""Corpus scans: files to documents, source registries, snapshots."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import fixed

# Languages and default include globs by extension.
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".pyi": "python", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp",
    ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".js": "javascript", ".f90": "fortran", ".f": "fortran", ".for": "fortran",
}


def lookup(value: Column, table: Mapping[str, str]) -> Column:
    """Value of a small fixed mapping, null when absent."""
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(literal, value)


def extension(path: Column) -> Column:
    """Lower-case suffix of the file name with its dot; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def document_format(path: Column) -> Column:
    return lookup(extension(path), fixed.EXTENSION_FORMATS)


def detect_language(path: Column) -> Column:
    return lookup(extension(path), LANGUAGE_BY_EXTENSION)


def in_ignored_dir(path: Column, ignored: Sequence[str] = fixed.IGNORED_DIRS) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in ignored]))


def read_binary(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def load_directory(spark: SparkSession, root: str, encoding: str = "UTF-8") -> DataFrame:
    """documents(path, format, text, error): known extensions outside ignored directories.

    Unknown files are dropped on the path before any content is read. Bytes that are no valid
    text give an error in the row; other rows are not affected.
    """
    found = read_binary(spark, root).withColumn("format", document_format(F.col("path")))
    kept = found.where(F.col("format").isNotNull() & ~in_ignored_dir(F.col("path")))
    readable = F.is_valid_utf8("content") & (F.col("format") != "pdf")
    return kept.select(
        "path",
        "format",
        F.when(readable, F.decode("content", encoding)).otherwise(F.lit("")).alias("text"),
        F.when(F.col("format") == "pdf", "unsupported: pdf text")
        .when(~readable, "not valid UTF-8")
        .alias("error"),
    )


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """(path, fingerprint) from size and modification time; file contents are not read."""
    files = read_binary(spark, root).select("path", "length", "modificationTime")
    mark = F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return files.where(~in_ignored_dir(F.col("path"))).select("path", mark.alias("fingerprint"))


def glob_to_regex(pattern: str) -> str:
    """Anchored regex of a glob: ``**/`` spans folders, ``*`` and ``?`` stay within one."""
    out = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def _any_glob(path: Column, globs: Sequence[str], tail: bool = False) -> Column:
    hit = F.lit(False)
    for glob in globs:
        pattern = glob_to_regex(glob)
        hit = hit | path.rlike("(?:^|/)" + pattern[1:] if tail else pattern)
    return hit


def collect_sources(files: DataFrame, sources: Sequence[Mapping]) -> tuple[DataFrame, DataFrame]:
    """Files of each source and the sources without a file.

    ``files`` has (root, path); ``sources`` is the parameter list of dicts with name, root,
    include and exclude. A file belongs to a source once, however many globs match it.
    """
    spark = files.sparkSession
    wanted = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col("root") == s["root"])
                    & _any_glob(F.col("path"), s.get("include", ["**/*"]))
                    & ~_any_glob(F.col("path"), s.get("exclude", []), tail=True)
                    & ~in_ignored_dir(F.col("path")),
                    F.lit(s["name"]),
                )
                for s in sources
            ]
        )
    )
    found = files.select("root", "path", F.explode(wanted).alias("source")).dropDuplicates(["source", "path"])
    declared = spark.createDataFrame([(s["name"], s["root"]) for s in sources], "source string, root string")
    return found, declared.join(found.select("source").distinct(), "source", "left_anti")


def ingest_rollup(files: DataFrame) -> DataFrame:
    """Files, repaired files and errors per source from (source, repairs, error) rows."""
    return files.groupBy("source").agg(
        F.count(F.lit(1)).alias("files_ingested"),
        F.count_if(F.col("repairs") > 0).alias("files_repaired"),
        F.count("error").alias("errors"),
    )
