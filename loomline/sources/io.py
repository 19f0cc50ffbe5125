"""Readers and writers: parquet, tolerant and strict JSON lines, text, requests and reports (SC, SK)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.plans import scratch

CORRUPT = "_corrupt"


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All parquet files under a folder, or some columns of them (SC1, SC3)."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return df.select(*columns) if columns else df


def row_count(df: DataFrame) -> DataFrame:
    """Rows as one row; parquet answers it without reading columns (SC2)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def first_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """A prefix of an explicit order (SC4, SC9)."""
    return df.orderBy(*order).limit(n)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a declared type; blank lines are no rows (SC5)."""
    return spark.read.schema(schema).json(path)


def tolerant_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and what did not parse as ``raw, reason`` (SC6)."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = F.col(f"r.{CORRUPT}").isNotNull() | F.col("r").isNull()
    good = rows.filter(~bad).select(*(F.col("r")[f.name].alias(f.name) for f in schema.fields))
    return good, rows.filter(bad).select(F.col("value").alias("raw"), F.lit("json_parse_error").alias("reason"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``path, text`` (SC14)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def events_of_stream(lines: DataFrame) -> DataFrame:
    """Data lines of server-sent events, ``lines(message_id, seq, line)``, as parsed rows (SC15)."""
    data = lines.filter(F.col("line").startswith("data:")).withColumn("json", F.trim(F.substring("line", 6, 1 << 30)))
    v = F.try_parse_json("json")
    pick = lambda path, kind="string": F.try_variant_get(v, path, kind)
    return data.filter("json <> '[DONE]'").select(
        "message_id", "seq", pick("$.type").alias("type"), pick("$.index", "int").alias("block"), F.coalesce(pick("$.delta.text"), pick("$.delta.partial_json")).alias("delta")
    )


def folded_stream(events: DataFrame) -> DataFrame:
    """Deltas of each block in order, as one text (SC15, ST10)."""
    rows = events.filter("delta is not null").groupBy("message_id", "block").agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("d"))
    return rows.select("message_id", "block", F.array_join(F.transform("d", lambda x: x["delta"]), "").alias("text"))


def unfolded_stream(texts: DataFrame, size: int) -> DataFrame:
    """Texts of blocks as deltas of at most ``size`` characters (ST10)."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / size)).cast("int")
    rows = texts.select("message_id", "block", "text", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("part", "_k"))
    return rows.select("message_id", "block", "part", F.substring(F.col("text"), F.col("part") * size + 1, F.lit(size)).alias("delta"))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line; Spark's committer makes the folder complete or absent (SK1, SK4, SK8)."""
    df.write.mode(mode).json(path)


def batch_requests(samples: DataFrame, model: str, url: str = "/v1/chat/completions") -> DataFrame:
    """Request lines of a batch job: ``samples(sample_id, messages, budget)`` as ``value`` (SK2, D10)."""
    body = F.struct(F.lit(model).alias("model"), F.col("messages"), F.floor(F.col("budget") * 1.5).cast("int").alias("max_tokens"), F.lit(0.0).alias("temperature"))
    return samples.select(F.to_json(F.struct(F.col("sample_id").alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body"))).alias("value"))


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append rows whose key is not stored yet and return them; a second run adds nothing (SK5, SK6).

    What is returned is read back from a table in the shared folder; nothing stays cached.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    new = df.join(spark.read.schema(df.schema).json(path).select(key), key, "left_anti") if there else df
    kept = scratch.folder(spark, "appended")
    new.write.parquet(kept)
    new = spark.read.schema(df.schema).parquet(kept)
    new.write.mode("append").json(path)
    return new


def dataset_key(*parts) -> str:
    """Name of a derived dataset: hash of what it was made from (SK7)."""
    import hashlib

    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16]


def markdown(df: DataFrame, title: str) -> DataFrame:
    """A small table as lines of a report (SK3)."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |"))
    head = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    top = df.sparkSession.createDataFrame([(k, h) for k, h in enumerate(head)], "place int, line string")
    rows = df.select((F.row_number().over(Window.orderBy(*df.columns)) + len(head) - 1).alias("place"), cells.alias("line"))
    return top.unionAll(rows).orderBy("place")


def expanded_sections(text: DataFrame, key: str, column: str) -> DataFrame:
    """``# File: path`` sections of a context as rows ``path, body``."""
    parts = F.split(F.concat(F.lit("\n"), F.col(column)), "\n# File: ", -1)
    rows = text.select(key, F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("pos", "s"))
    return rows.select(key, "pos", F.trim(F.substring_index("s", "\n", 1)).alias("path"), F.regexp_replace("s", r"^[^\n]*\n?", "").alias("body"))


def framed_sections(sections: DataFrame, key: str) -> DataFrame:
    """Sections back to one context, in order."""
    part = F.concat(F.lit("# File: "), "path", F.lit("\n"), "body")
    return sections.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), "\n").alias("context"))
