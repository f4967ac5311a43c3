"""Files in and out: explicit schemas, no inference; and writes that are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.session import filesystem, shared_dir, temporary

#: Declared schemas of the inputs; a file that lacks a column gives nulls, one that has more is not read for it.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, source_row int, topic string, text_sha string, fetched_at timestamp",
    "records": "record_id bigint, source_shard string, ordinal int, start_tok bigint, end_tok bigint, token_sha string, text_sha string, split tinyint, text string, meta string, seen_at timestamp",
    "parses": "parse_id bigint, source_shard string, source_row int, parsed string",
    "split_items": "group_id string, source_shard string, source_row int, terminal_tokens int",
}


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines, also gzipped. A line that isn't an object of the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str, gzip: bool = True) -> None:
    df.write.option("compression", "gzip" if gzip else "none").option("ignoreNullFields", "false").json(path)


def read_tsv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Tab-separated with a header and without quoting."""
    return spark.read.schema(schema).option("sep", "\t").option("header", "true").option("quote", "").option("mode", "FAILFAST").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", "true").option("quote", "").option("escapeQuotes", "false").csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, bytes) of each line of text files, with the file's name and size."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_arrow(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Parquet files of a folder whose names match a glob; an error if none does."""
    fs, at = filesystem(spark, path.rstrip("/") + "/" + pattern)
    if not (fs.globStatus(at) or []):
        raise FileNotFoundError(f"no file matches {pattern} in {path}")
    return spark.read.option("pathGlobFilter", pattern).parquet(path)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-16 by its mark, UTF-8 (with or without a mark) where the bytes are valid as such,
    else Latin-1, which any bytes are. Null stays null."""
    head = F.substring(F.hex(content), 1, 6)
    utf8 = F.regexp_replace(content.cast("string"), "^\ufeff", "")
    return F.when(head.startswith("FEFF") | head.startswith("FFFE"), F.decode(content, "UTF-16")).when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(F.decode(content, "ISO-8859-1"))


def read_encoded(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files of mixed encodings; an empty file gives no row."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))


def schema_errors(df: DataFrame, schema: str | StructType) -> list[str]:
    """What is missing or of another type, by column; empty if df fits."""
    want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have = {f.name: f.dataType for f in df.schema}
    return [f"{f.name}: {'missing' if f.name not in have else f'{have[f.name].simpleString()}, not {f.dataType.simpleString()}'}" for f in want if have.get(f.name) != f.dataType]


def roundtrip(df: DataFrame, by: str) -> DataFrame:
    """(by, written, lost, added): df written as Parquet in folders by a column, read back, and
    compared both ways as multisets."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusmill/export-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    temporary(spark, path)
    back = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    n = lambda x, name: x.groupBy(by).agg(F.count("*").alias(name))
    out = n(back, "written").join(n(df.exceptAll(back), "lost"), by, "left").join(n(back.exceptAll(df), "added"), by, "left")
    return out.select(F.col(by).cast("int").alias(by), "written", F.coalesce("lost", F.lit(0)).alias("lost"), F.coalesce("added", F.lit(0)).alias("added"))


def unpacked(df: DataFrame, by: str) -> DataFrame:
    """(by, n, back, lost, added): df written as compressed JSON lines, read back with its schema, and
    compared both ways as multisets."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusmill/packed-{uuid.uuid4().hex}"
    write_json(df, path)
    temporary(spark, path)
    back = read_json(spark, path, df.schema)
    sides = {"n": df, "back": back, "lost": df.exceptAll(back), "added": back.exceptAll(df)}
    rows = None
    for name, side in sides.items():
        own = side.select(F.col(by).cast("int").alias(by), F.lit(name).alias("_side"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(by).agg(*(F.count_if(F.col("_side") == name).alias(name) for name in sides))


def publish(df: DataFrame, by: str, text: str, path: str | None = None) -> DataFrame:
    """Write df by a column into a folder beside `path`, compare what was written with df, write the manifest
    (by, row_count, chars, committed) into it and only then rename it to `path`: a reader sees all of it or
    nothing. An error, and nothing published, if a row was lost or `path` is there already. The manifest."""
    spark = df.sparkSession
    final = path or temporary(spark, f"{shared_dir(spark)}/corpusmill/published-{uuid.uuid4().hex}")
    aside = f"{final}.{uuid.uuid4().hex}"
    told = lambda d: d.groupBy(by).agg(F.count("*").alias("row_count"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"))
    df.write.partitionBy(by).parquet(f"{aside}/data")
    manifest = told(spark.read.schema(df.schema).parquet(f"{aside}/data").select(*df.columns))
    if not told(df).exceptAll(manifest).isEmpty():
        raise RuntimeError("what was written isn't what was to be written")
    manifest.select(F.col(by).cast("int").alias(by), "row_count", "chars", F.lit(True).alias("committed")).write.parquet(f"{aside}/manifest")
    fs, at = filesystem(spark, aside)
    to = filesystem(spark, final)[1]
    if fs.exists(to) or not fs.rename(at, to):
        raise FileExistsError(final)
    if path is None:
        temporary(spark, final)
    return spark.read.parquet(f"{final}/manifest")
