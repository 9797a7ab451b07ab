"""Chat records from JSON lines: a typed message table, malformed rows kept aside, a stable record number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import prompt_key
from ..session import checkpoint

#: Messages stay variants, so one odd element costs its record a reason and not all its messages.
SCHEMA = "messages array<variant>, _corrupt_record string"
#: Splits whose line counts are broadcast, some 40 bytes each.
SPLITS = 1_000_000


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(rec_id, value): the lines that aren't blank, by file, split and place from 0, so a number doesn't depend on how files are split.

    Lines stay in the tasks that read them: a first pass counts each split's lines, prefix sums over one row a split come back as a
    broadcast (up to ``SPLITS`` of them; a shuffle beyond). Both passes must see the same splits; if these have changed, the second
    one fails instead of giving wrong numbers.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__b")).where(F.col("value").rlike(r"\S"))
    raw = raw.withColumn("__m", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__m", 33)).withColumn("__f", F.xxhash64("__path"))
    split = raw.groupBy("__f", "__b", "__part").agg(F.min("__path").alias("__path"), F.max("__path").alias("__last"), F.count("*").alias("__n"), F.min("__m").alias("__first"))
    split = checkpoint(split.withColumn("__path", F.when(F.col("__path") == F.col("__last"), F.col("__path")).otherwise(F.raise_error(F.lit("two files share a hash")))))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__path", "__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = split.select("__f", "__b", "__part", (before - F.col("__first")).alias("__offset"))
    offset = F.broadcast(offset) if split.count() <= SPLITS else offset
    known = F.when(F.col("__offset").isNotNull(), F.col("__offset")).otherwise(F.raise_error(F.lit("the source's splits changed between two passes")).cast("long"))
    return raw.drop("__path").join(offset, ["__f", "__b", "__part"], "left").select((F.col("__m") + known).alias("rec_id"), "value")


def parsed(lines_: DataFrame) -> DataFrame:
    """(rec_id, digest, messages, _corrupt_record) of (rec_id, value): a malformed line has null messages."""
    r = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines_.select("rec_id", F.md5(F.col("value").cast("binary")).alias("digest"), r.alias("r")).select("rec_id", "digest", "r.messages", "r._corrupt_record")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(rec_id, digest, messages, _corrupt_record): blank lines vanish, a malformed line has null messages."""
    return parsed(numbered(spark, path))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def field(v: Column, name: str, kind: str = "variant") -> Column:
    """A message's field; null where the element is no object or has none."""
    return F.when(is_object(v), F.try_variant_get(v, f"$.{name}", kind))


def kind(v: Column) -> Column:
    """Python's name of a variant's type if it is neither text nor null; else null."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | s.isin("STRING", "VOID"), F.lit(None).cast("string"))
        .when(s.startswith("ARRAY"), "list").when(s.startswith("OBJECT"), "dict").when(s == "BOOLEAN", "bool")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "float").otherwise("int")
    )


def text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def truthy(v: Column) -> Column:
    """Whether a value counts as true: not null, empty, zero or false."""
    return F.when(v.isNull() | (F.schema_of_variant(v) == "VOID"), F.lit(False)).otherwise(~F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("x")).isin("", "[]", "{}", "0", "0.0", "false"))


def messages(chat: DataFrame) -> DataFrame:
    """The message table of readable records; ``shape`` is the reason to reject a record for an element that is no object."""
    x = chat.where(F.col("messages").isNotNull()).select("rec_id", F.posexplode("messages").alias("i", "m"))
    m = F.col("m")
    return x.select(
        "rec_id", F.col("i").cast("long").alias("msg_idx"), field(m, "role", "string").alias("role"), text(field(m, "content")).alias("content"), kind(field(m, "content")).alias("content_type"),
        truthy(field(m, "tool_calls")).alias("tool_calls"), text(field(m, "reasoning_content")).alias("reasoning"), F.when(~is_object(m), "error:AttributeError").alias("shape"),
    )


def index(chat: DataFrame) -> DataFrame:
    """(rec_id, prompt_key, n_messages): -1 messages for a row that can't be read, whose first user content is no text, or that has
    something else than an object before its first user message."""
    role = lambda m: F.coalesce(field(m, "role", "string"), F.lit(""))
    first = F.try_element_at(F.filter("messages", lambda m: role(m) == "user"), F.lit(1))
    until = F.filter("messages", lambda m: (role(m) == "user") | ~is_object(m))
    odd = (F.size(until) > 0) & ~is_object(F.try_element_at(until, F.lit(1)))
    bad = F.col("messages").isNull() | odd | kind(field(first, "content")).isNotNull()
    return chat.select("rec_id", F.when(bad, "").otherwise(prompt_key(text(field(first, "content")))).alias("prompt_key"), F.when(bad, -1).otherwise(F.size("messages")).cast("int").alias("n_messages"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines, byte for byte, for filters that pass lines on."""
    return spark.read.text(path)
