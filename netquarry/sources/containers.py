"""Records in JSON arrays and objects, of any size, and fingerprints of records' shapes.

A file with one large array has no lines to split it at. It is read in fragments that end at a closing brace, in as many tasks as it has
blocks. Whether a fragment begins within a string, and how deep it is, are running sums over the fragments before it: within each block, and over
the blocks' totals. An object ends where the depth comes back to nothing, and only an object's own fragments meet. So a file is never in one task.

A fingerprint names a record's keys in order with the kinds of their values, objects to a depth of DEPTH; values never appear. Text records have one by their format.

Defined cases: an object of more than ``most`` bytes, or one that its file doesn't close, is a failure and is not put together; what stands between objects at the top
and is no object (numbers, strings, nulls) is a failure each; several arrays or objects in a file follow each other. Objects in arrays of arrays are records too.
A null record has no fingerprint; text that is no JSON object has that of text; repeated keys of an object are a failure of its shape (null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.scratch import stored

MOST_BYTES, DEPTH = 1 << 20, 3
#: Names of kinds.
KINDS = (("ARRAY", "list"), ("BIGINT", "int"), ("STRING", "str"), ("BOOLEAN", "bool"), ("DECIMAL", "float"), ("DOUBLE", "float"), ("FLOAT", "float"), ("VOID", "NoneType"))


def _running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of the values of all earlier fragments of the file: within the block, and of the blocks before."""
    rows = rows.withColumn("_v", value.cast("long"))
    blocks = rows.groupBy("source", "block").agg(F.sum("_v").alias("_all"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_all").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_all")
    inside = F.coalesce(F.sum("_v").over(W.partitionBy("source", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inside", inside).join(blocks, ["source", "block"]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_v", "_inside", "_before")


def _count(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(source, block, at, text): the files' text, each piece but a file's last up to a closing brace."""
    rows = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    return stored(rows, "fragments")  # the order within a block is kept from here on


def read_objects(spark: SparkSession, path: str, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(records, failures): (source, place, raw) of each object of the files, place: its number in the file from 1; (source, place, reason)."""
    rows = fragments(spark, path).withColumn("clean", F.regexp_replace("text", r"\\.", "__"))
    rows = _running(rows, _count(F.col("clean"), '"') % 2, "_quotes").withColumn("_in", F.col("_quotes") % 2 == 1)
    outside = F.regexp_replace(F.when(F.col("_in"), F.regexp_replace("clean", r'^[^"]*("|$)', "")).otherwise(F.col("clean")), r'"[^"]*("|$)', '"')
    ends_in = (_count(F.col("clean"), '"') % 2 == 1) != F.col("_in")
    rows = rows.withColumn("outside", outside)
    closes = (~ends_in).cast("int")  # a file's last piece has no brace; what it would close is nothing
    rows = _running(rows, _count(F.col("outside"), "{") - closes, "_depth").withColumn("_after", F.col("_depth") + _count(F.col("outside"), "{") - closes)
    rows = _running(rows, (F.col("_after") == 0).cast("int") * closes, "_ended").withColumn("place", F.col("_ended") + 1)
    opens = F.instr("text", "{")
    head = F.when(F.col("_depth") == 0, F.when(opens > 0, F.left("text", opens - 1)).otherwise(F.col("text"))).otherwise("")
    body = F.when(F.col("_depth") == 0, F.when(opens > 0, F.substr("text", opens)).otherwise("")).otherwise(F.col("text"))
    rows = rows.withColumns({"head": head, "body": body, "ends": (F.col("_after") == 0) & (closes == 1)})
    whole = rows.groupBy("source", "place").agg(F.sum(F.octet_length("body") + 1).alias("bytes"), F.max("ends").alias("ends"), F.max(F.length("body") > 0).alias("any"))
    fits = whole.where(F.col("ends") & F.col("any") & (F.col("bytes") <= most)).select("source", "place")
    pieces = rows.join(fits, ["source", "place"], "left_semi").groupBy("source", "place").agg(F.array_sort(F.collect_list(F.struct("block", "at", "body"))).alias("p"))
    records = pieces.select("source", "place", F.concat(F.array_join(F.transform("p", lambda x: x["body"]), "}"), F.lit("}")).alias("raw"))
    bad = whole.where(F.col("any") & ~(F.col("ends") & (F.col("bytes") <= most))).select("source", "place", F.when(~F.col("ends"), "not closed").otherwise("too long").alias("reason"))
    scalars = F.filter(F.split(F.regexp_replace("head", r"[\[\]\s]", ""), ","), lambda x: x != "")
    between = rows.where(F.length("head") > 0).select("source", "place", F.explode(scalars)).select("source", "place", F.lit("no object").alias("reason"))
    return records, bad.unionByName(between)


def _kind(value: Column, depth: int) -> Column:
    named = F.schema_of_variant(value)
    out = F.when(named.startswith("OBJECT"), F.concat(F.lit("{"), _shape(value.cast("map<string,variant>"), depth + 1), F.lit("}")) if depth < DEPTH else F.lit("dict"))
    for start, name in KINDS:
        out = out.when(named.startswith(start), name)
    return out.otherwise("str")


def _shape(entries: Column, depth: int) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_keys(entries)), lambda k: F.concat(k, F.lit(":"), _kind(F.element_at(entries, k), depth))), ",")


def fingerprint(raw: Column) -> Column:
    """The shape of a record: of a JSON object by its keys, else of text by its format."""
    text = F.trim(raw, F.lit(" \t\r\n"))
    parts = F.split(text, r"\|")
    words = F.size(F.array_remove(F.split(text, r"\s+"), ""))
    close = F.instr(text, ">")
    syslog = text.startswith("<") & close.between(1, 10) & (F.length(text) > close)
    of_text = (
        F.when(text.startswith("CEF:"), F.when(F.size(parts) >= 8, F.concat_ws("|", F.lit("CEF"), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3)))).otherwise("CEF|Malformed"))
        .when(syslog, F.when(F.substr(text, close + 1, F.lit(1)).rlike("[0-9]"), "SYSLOG|RFC5424").otherwise("SYSLOG|RFC3164"))
        .when(words > 0, F.concat(F.lit("TEXT|"), words.cast("string"), F.lit("_words"))).otherwise("TEXT|EMPTY")
    )
    parsed = F.try_parse_json(raw)
    is_object = text.startswith("{") & parsed.isNotNull()
    return F.when(raw.isNull(), None).when(is_object, _shape(F.when(is_object, parsed).cast("map<string,variant>"), 0)).otherwise(of_text)
