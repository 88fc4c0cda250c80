"""Files as rows, Python and RST corpora, and what is written back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import code


def listing(spark: SparkSession, directory: str, extension: str | None = None) -> DataFrame:
    """(path, size, modified) of all files below a directory."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extension:
        reader = reader.option("pathGlobFilter", f"*{extension}")
    return reader.load(directory).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def subdirectories(files: DataFrame, directory: str) -> DataFrame:
    """(name) of the directories right below one, as far as they hold files."""
    rest = F.regexp_extract("path", rf"\Q{directory.rstrip('/')}\E/([^/]+)/", 1)
    return files.select(rest.alias("name")).filter("name <> ''").distinct()


def _hadoop(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def make_directory(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.mkdirs(p)


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(to))


def copy(spark: SparkSession, path: str, to: str) -> bool:
    (a, p), (b, q) = _hadoop(spark, path), _hadoop(spark, to)
    return spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, spark._jsc.hadoopConfiguration())


def texts(spark: SparkSession, directory: str, extension: str) -> DataFrame:
    """(filename, content); bytes that aren't UTF-8 are left out."""

    @F.pandas_udf("string")
    def lenient(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore"))

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").load(directory)
    return raw.select(F.col("path").alias("filename"), lenient("content").alias("content"))


def python_values(spark: SparkSession, directory: str, value_column: str = "code", minify: bool = False, remove_docstrings: bool = False, resolution: str = "both") -> DataFrame:
    """(value, filename) of a Python corpus: rows for functions, classes, both, or whole modules (resolution). Files that don't parse give no entity."""
    if resolution not in ("function", "class", "both", "module"):
        raise ValueError(f"unknown resolution {resolution!r}")
    files = texts(spark, directory, ".py")
    if resolution == "module":
        rows = files.select(F.col("content").alias(value_column), "filename")
    else:
        each = files.select("filename", F.explode(code.entities("content")).alias("e"))
        each = each if resolution == "both" else each.filter(F.col("e.kind") == resolution)
        rows = each.select(F.col("e.code").alias(value_column), "filename")
    if minify or remove_docstrings:
        change = code.minified if minify else code.without_docstrings
        rows = rows.withColumn(value_column, change(F.col(value_column)))
    return rows


def documentation(spark: SparkSession, directory: str, value_column: str = "content") -> DataFrame:
    """(filename, value) of an RST corpus."""
    return texts(spark, directory, ".rst").withColumnRenamed("content", value_column)


def requests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of NDJSON; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def generated_content(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored results in order of id."""
    return requests(spark, path, schema).orderBy("id")


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def replaced(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(filename, content) of files with each change (filename, original, replacement) made, in order of the original text.

    The sources stay as they are; the caller writes the result where it belongs.
    """
    listed = changes.groupBy("filename").agg(F.sort_array(F.collect_list(F.struct("original", "replacement"))).alias("_c"))
    new = F.aggregate("_c", F.col("content"), lambda s, c: F.replace(s, c["original"], c["replacement"]))
    return files.join(listed, "filename", "left").select("filename", F.when(F.col("_c").isNull(), F.col("content")).otherwise(new).alias("content"))


def rst_stub(module: Column) -> Column:
    """A page with the module's name as title and its members."""
    return F.concat(module, F.lit("\n"), F.repeat(F.lit("="), F.length(module)), F.lit("\n\n.. automodule:: "), module, F.lit("\n   :members:\n"))


def rst_stubs(modules: DataFrame, existing: DataFrame) -> DataFrame:
    """(module, page) for modules (module) without a page yet; existing: (module)."""
    return modules.join(existing, "module", "left_anti").select("module", rst_stub(F.col("module")).alias("page"))


def rst_members(files: DataFrame) -> DataFrame:
    """(filename, page): a directive for every top-level class and function, in order; files: (filename, module, content)."""
    each = files.select("filename", "module", F.explode(code.entities("content")).alias("e")).filter("e.top")
    kind = F.when(F.col("e.kind") == "class", "autoclass").otherwise("autofunction")
    line = F.concat(F.lit(".. "), kind, F.lit(":: "), "module", F.lit("."), "e.name")
    pages = each.select("filename", F.struct(F.col("e.position").alias("at"), line.alias("line")).alias("r")).groupBy("filename").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    return pages.select("filename", F.array_join(F.transform("rs", lambda r: r["line"]), "\n\n").alias("page"))


def page_map(documents: DataFrame, sources: DataFrame, documents_root: str, sources_root: str) -> DataFrame:
    """(document, source): listings joined on the relative path without its extension."""

    def keyed(df: DataFrame, root: str, name: str) -> DataFrame:
        rest = F.regexp_replace(F.regexp_replace("path", rf"^.*\Q{root.rstrip('/')}\E/", ""), r"\.[^./]+$", "")
        return df.select(rest.alias("_key"), F.col("path").alias(name))

    return keyed(documents, documents_root, "document").join(keyed(sources, sources_root, "source"), "_key").drop("_key")
