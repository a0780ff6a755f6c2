"""File sources: discovery, CSV with encoding fallback, JSON shapes, alias-driven columns, markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Header aliases of each field, in order of preference.
ALIASES = {
    "question": ["question", "query", "prompt", "title"],
    "answer": ["answer", "response", "reply", "body"],
    "category": ["category", "topic", "subcategory"],
    "url": ["url", "link", "url_link"],
    "language": ["language", "lang"],
}
EXPECTED = ["Url_Link", "Query", "FatwahNo", "Question", "Answer"]


def discover(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """(path, length) of all files under root that match, sorted by path; files of no bytes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length").orderBy("path")


def encodings(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """(path, encoding, has_bom, head): UTF-8 if every line's bytes are valid, else the single-byte Arabic charset, or Latin-1 where a
    byte has no meaning there; and the first line. Files are read as lines in one job, so none need fit in memory."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    raw = F.col("value").cast("binary")  # a line's bytes as they are in the file
    meta = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_block_start").alias("start"), raw.alias("raw"), F.monotonically_increasing_id().alias("n"))
    good = F.min(F.is_valid_utf8(F.col("raw").cast("string")))
    arabic = ~F.max(F.hex("raw").rlike("^(?:..)*(?:00)"))
    seen = meta.groupBy("path").agg(good.alias("utf8"), arabic.alias("arabic"), F.max("length").alias("length"), F.min_by("raw", F.struct("start", "n")).alias("head"))
    return seen.select("path", F.when(F.col("utf8"), "UTF-8").when(F.col("arabic"), "windows-1256").otherwise("ISO-8859-1").alias("encoding"), (F.hex(F.substring("head", 1, 3)) == "EFBBBF").alias("has_bom"), "length", F.hex("head").alias("head"))


def read_csv(spark: SparkSession, paths: list[str], encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, malformed rows dropped, nulls to blanks, the source path kept."""
    if encoding.upper() != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # single-byte charsets beyond Latin-1
    df = spark.read.csv(paths, header=True, inferSchema=False, mode="DROPMALFORMED", multiLine=True, quote='"', escape='"', encoding=encoding)
    clean = [c.lstrip("﻿") for c in df.columns]
    return df.toDF(*clean).na.fill("").withColumn("source_path", F.input_file_name())


def read_csv_tree(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """Every CSV under root in the encoding that fits it, columns united by name; empty files are left out.

    One job reads the headers; files are grouped by header on the driver (names only), so each group is one scan."""
    groups: dict[tuple, list[str]] = {}
    for r in encodings(spark, root, pattern).where("length > 0").collect():
        groups.setdefault((r.encoding, r.head), []).append(r.path)
    parts = [read_csv(spark, paths, enc) for (enc, head), paths in sorted(groups.items()) if head]
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField("source_path", T.StringType())]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def strict_columns(df: DataFrame) -> DataFrame | None:
    """The fixed contract's columns, or None if one is missing (names are case-sensitive)."""
    return df.select(*EXPECTED) if set(EXPECTED) <= set(df.columns) else None


def pick_column(columns: list[str], field: str) -> str | None:
    """The first alias of a field among the headers, ignoring case and reading spaces as underscores."""
    known = {c.strip().lower().replace(" ", "_"): c for c in columns}
    return next((known[a] for a in ALIASES[field] if a in known), None)


def by_aliases(df: DataFrame, language: str = "ur") -> DataFrame | None:
    """Question, answer, category, url and language by alias, or None without a question or answer column."""
    found = {f: pick_column(df.columns, f) for f in ALIASES}
    if not found["question"] or not found["answer"]:
        return None
    cols = [F.coalesce(F.trim(F.col(c)), F.lit("")).alias(f) if c else F.lit(language if f == "language" else "").alias(f) for f, c in found.items()]
    return df.select(*cols).where("not (question = '' and answer = '')")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, an array, one object, or an object whose ``records`` are the rows."""
    df = spark.read.json(path, multiLine=not path.endswith(".jsonl"))
    return df.select(F.explode("records").alias("r")).select("r.*") if df.columns == ["records"] else df


def sample_rows(spark: SparkSession, paths: list[str], n: int = 100) -> list[DataFrame]:
    """The first n rows of each file, for profiling."""
    return [spark.read.csv(p, header=True).limit(n) for p in paths]


def row_estimates(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """(path, rows): physical lines less the header."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    return lines.groupBy(F.col("_metadata.file_path").alias("path")).agg((F.count("*") - 1).alias("rows"))


def markdown_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, line, text) of whole markdown files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("id"), "value")
    return files.select("id", F.posexplode(F.split("value", "\n")).alias("line", "text"))


def synthetic(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """A seeded corpus of n records, six in ten short, three medium, one long."""
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10))
    size = F.when(u < 6, 20).when(u < 9, 120).otherwise(600)
    word = lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(seed), k), F.lit(5000)).cast("string"))
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), word), " ").alias("question"), F.array_join(F.transform(F.sequence(F.lit(1), size), word), " ").alias("answer"), F.concat(F.lit("c"), F.pmod("id", F.lit(4)).cast("string")).alias("category"))


def with_source(df: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Rows of a CSV tree with what their path says: source (two folders up), category (the folder), subcategory (the stem).

    ``names(source, source_name, group)`` adds a source's display name and group."""
    parts = F.split(F.regexp_replace("source_path", "^[a-z]+:/+", "/"), "/")
    up = lambda k: F.coalesce(F.try_element_at(parts, F.lit(-k)), F.lit(""))
    out = df.withColumns({"source": up(3), "category": up(2), "subcategory": F.regexp_replace(up(1), r"(_output)?\.[A-Za-z0-9]+$", "")})
    return out if names is None else out.join(F.broadcast(names), "source", "left")


def load_documents(spark: SparkSession, root: str, pattern: str = "*_output.csv", names: DataFrame | None = None) -> DataFrame:
    """All files of the fixed contract under root as documents; a file that lacks an expected column is left out as a whole, as are
    rows without question and answer. Where root has no such file, its ``data`` folder is read."""
    rows = read_csv_tree(spark, root, pattern)
    if not set(EXPECTED) <= set(rows.columns) and not root.rstrip("/").endswith("/data"):
        rows = read_csv_tree(spark, f"{root.rstrip('/')}/data", pattern)
    if not set(EXPECTED) <= set(rows.columns):
        raise ValueError(f"no file under {root} has the columns {EXPECTED}")
    # united by name: a column that a file lacks is null in all of its rows, one that it has is blank at least
    whole = rows.where(" and ".join(f"`{c}` is not null" for c in EXPECTED))
    clean = whole.select(*[F.trim(c).alias(c) for c in EXPECTED], "source_path").where("not (Question = '' and Answer = '')")
    return with_source(clean, names)


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries of a JSON array: label, question, expected_category, expected_keywords, category_filter."""
    return spark.read.schema("label string, question string, expected_category string, expected_keywords array<string>, category_filter string").json(path, multiLine=True)
