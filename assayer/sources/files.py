"""Reading tables, text and image corpora, and fingerprints of files."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from assayer import fixed_values as fv
from assayer.functions.keys import row_key

LONG_TEXT = r"\A[+-]?\d{1,19}\z"
DOUBLE_TEXT = r"\A([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(inf|Inf|INF|infinity|Infinity|INFINITY))\z"


def null_spellings(cell: Column) -> Column:
    return F.when(~F.coalesce(cell, F.lit("")).isin(*fv.NULL_SPELLINGS), cell)


def cell_kinds(cell: Column) -> dict[str, Column]:
    """Whether a cell, null included, fits each promoted type."""
    text = F.trim(cell)
    empty = cell.isNull()
    # The pattern comes first: a failing cast is slow. Up to 18 digits always fit.
    short, long = text.rlike(r"\A[+-]?\d{1,18}\z"), text.rlike(LONG_TEXT)
    return {
        "bigint": empty | short | (long & text.try_cast("bigint").isNotNull()),
        "double": empty | text.rlike(DOUBLE_TEXT),
        "boolean": empty | cell.isin(*fv.BOOLEAN_SPELLINGS),
    }


def promote(df: DataFrame) -> DataFrame:
    """Give each string column the first type all its values fit: long, double,
    boolean, else string; dates stay text. One aggregate decides for all columns."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    cells = {c: null_spellings(F.col(f"`{c}`")) for c in names}
    tests = [
        F.bool_and(cond).alias(f"{kind}_{i}") for i, c in enumerate(names) for kind, cond in cell_kinds(cells[c]).items()
    ]
    filled = [F.count(cells[c]).alias(f"n_{i}") for i, c in enumerate(names)]
    facts = df.agg(*tests, *filled).first()
    typed = {}
    for i, c in enumerate(names):
        if not facts[f"n_{i}"]:
            typed[c] = F.lit(None).cast("double")
        elif facts[f"bigint_{i}"]:
            typed[c] = F.trim(cells[c]).cast("bigint")
        elif facts[f"double_{i}"]:
            typed[c] = F.trim(cells[c]).cast("double")
        elif facts[f"boolean_{i}"]:
            typed[c] = F.lower(cells[c]).cast("boolean")
        else:
            typed[c] = cells[c]
    return df.withColumns(typed)


def read_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Header row, all columns read as text and then promoted."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
    return promote(reader.csv(path))


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_json(spark: SparkSession, path: str | Sequence[str], lines: bool = False) -> DataFrame:
    """One array of records per file, or one record per line (which can be split)."""
    return spark.read.option("multiLine", not lines).json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Table by suffix."""
    suffix = "." + path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == ".csv":
        return read_csv(spark, path)
    if suffix in (".parquet", ".pq"):
        return read_parquet(spark, path)
    if suffix == ".json":
        return read_json(spark, path)
    raise ValueError(f"unsupported table: {path}")


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def _glob(suffixes: Sequence[str]) -> str:
    """Case-insensitive file-name glob of a suffix family."""
    def both(s: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)

    return "*{" + ",".join(both(s) for s in suffixes) + "}"


def _binary(spark: SparkSession, path: str | Sequence[str], recursive: bool = True, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def empty_files(raw: DataFrame) -> DataFrame:
    """(path) of files without a byte: readers list them but give no row.

    The names come from the file index, which the driver holds anyway.
    """
    listed = raw.sparkSession.createDataFrame([(p,) for p in raw.inputFiles()], "uri string")
    listed = listed.select(F.regexp_replace("uri", "^file:/+", "file:/").alias("uri"))
    missing = listed.join(raw.select(F.col("_metadata.file_path").alias("uri")), "uri", "left_anti")
    return missing.select(F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B"))).alias("path"))


def list_files(spark: SparkSession, path: str | Sequence[str], recursive: bool = True, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, suffix); file contents are not read.
    Empty files have no time."""
    raw = _binary(spark, path, recursive, glob)
    listed = raw.select("path", "modificationTime", "length")
    empty = empty_files(raw).withColumn("length", F.lit(0).cast("bigint"))
    return listed.unionByName(empty, allowMissingColumns=True).withColumn("suffix", _suffix(F.col("path")))


def read_text_corpus(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, text): one document per .txt, .md or .log file; bytes that are not
    UTF-8 are dropped."""
    raw = _binary(spark, path, glob=_glob(fv.TEXT_SUFFIXES))
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return raw.select("path", text.alias("text")).unionByName(empty_files(raw).withColumn("text", F.lit("")))


def read_image_corpus(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, width, height, channels, data), undecodable files with width -1."""
    glob = _glob(fv.IMAGE_SUFFIXES)
    reader = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True)
    raw = reader.option("pathGlobFilter", glob).load(path)
    images = raw.select(
        F.col("image.origin").alias("path"), "image.width", "image.height",
        F.col("image.nChannels").alias("channels"), "image.data",
    )
    none = F.lit(-1)
    empty = empty_files(_binary(spark, path, glob=glob)).select(
        "path", none.alias("width"), none.alias("height"), none.alias("channels"), F.lit(b"").alias("data")
    )
    return images.unionByName(empty)


def modality_counts(files: DataFrame) -> DataFrame:
    """Files per family, and the modality they speak for; images win ties over
    tables, tables over texts, and nothing known means a table."""
    s = F.col("suffix")
    counts = files.agg(
        F.count_if(s.isin(*fv.IMAGE_SUFFIXES)).alias("images"),
        F.count_if(s.isin(*fv.TABULAR_SUFFIXES)).alias("tables"),
        F.count_if(s.isin(*fv.TEXT_SUFFIXES)).alias("texts"),
    )
    i, t, x = F.col("images"), F.col("tables"), F.col("texts")
    modality = (
        F.when((i > 0) & (i >= F.greatest(t, x)), "image").when((t > 0) & (t >= F.greatest(i, x)), "tabular")
        .when(x > 0, "text").otherwise("tabular")
    )
    return counts.withColumn("modality", modality)


def detect_modality(spark: SparkSession, path: str) -> DataFrame:
    """Modality of a folder, by the files directly in it."""
    return modality_counts(list_files(spark, path, recursive=False))


# ---------------------------------------------------------------- fingerprints


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One SHA-256 per table, the same for any row order or partitioning.

    Row digests are folded by count, sum and xor, so equal rows still count.
    """
    key = row_key(df)
    one, two = F.xxhash64(F.to_json(key)), F.xxhash64(F.lit("b"), F.to_json(key))
    shape = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    low = F.lit(0xFFFFFFFF)
    folded = df.agg(
        F.count("*").alias("n"),
        F.sum(one.bitwiseAND(low).cast("decimal(38,0)")).alias("s1"), F.sum(F.shiftrightunsigned(one, 32).cast("decimal(38,0)")).alias("s2"),
        F.sum(two.bitwiseAND(low).cast("decimal(38,0)")).alias("s3"), F.bit_xor(one).alias("x1"), F.bit_xor(two).alias("x2"),
    )
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n", "s1", "s2", "s3", "x1", "x2")]
    return folded.select(F.sha2(F.concat_ws("|", F.lit(shape), *parts), 256).alias("fingerprint"))


def file_fingerprints(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, file_hash): SHA-256 of each file's bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.sha2("content", 256).alias("file_hash"))


def folder_fingerprint(files: DataFrame, root: str) -> DataFrame:
    """SHA-256 over (relative path, file hash) in path order.

    One digest line per file is gathered, not file contents.
    """
    relative = F.regexp_replace("path", rf"\A.*?{root.rstrip('/')}/".replace("//", "/+"), "")
    listed = files.agg(F.sort_array(F.collect_list(F.struct(relative.alias("p"), "file_hash"))).alias("l"))
    joined = F.array_join(F.transform("l", lambda e: F.concat(e["p"], e["file_hash"])), "")
    return listed.select(F.sha2(joined, 256).alias("fingerprint"))


def combine_fingerprints(hashes: DataFrame, order: str, column: str) -> DataFrame:
    """SHA-256 over the hashes of a list of inputs, in order."""
    listed = hashes.agg(F.sort_array(F.collect_list(F.struct(order, column))).alias("l"))
    return listed.select(F.sha2(F.array_join(F.transform("l", lambda e: e[column]), ""), 256).alias("fingerprint"))
