"""Text forms: strings by line, query lines, result lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodevec.functions import vector as V


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """(id, value): lines of a DataFrame numbered from 0 in partition order, without gathering them: partitions are
    counted first, then each numbers its own from its offset."""
    tagged = lines.select("value", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    counts = tagged.groupBy("p").agg(F.count("*").alias("n"), F.min("m").alias("m0"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("p", "m0", before.alias("start"))
    return tagged.join(F.broadcast(offsets), "p").select((F.col("m") - F.col("m0") + F.col("start")).alias("id"), "value")


def load_strings(spark: SparkSession, path: str) -> DataFrame:
    """(id, str): a row a line, blank ones too, id from 0."""
    return with_line_numbers(spark.read.text(path)).withColumnRenamed("value", "str")


def parse_queries(lines: DataFrame) -> DataFrame:
    """(qid, regex, qvec) of (id, value) lines: pattern, white space, numbers. A tab, where there is one, ends the
    pattern, which may then hold blanks; numbers may stand in brackets with commas. Lines without pattern or numbers,
    or with anything else among the numbers, are left out; the others keep their line number."""
    v = F.trim(F.col("value"))
    tabbed = F.instr(v, "\t") > 0
    regex = F.when(tabbed, F.substring_index(v, "\t", 1)).otherwise(F.split(v, r"\s+", 2)[0])
    rest = F.when(tabbed, F.expr("substring(trim(value), instr(trim(value), '\t') + 1)")).otherwise(F.get(F.split(v, r"\s+", 2), F.lit(1)))
    got = lines.select(F.col("id").alias("qid"), regex.alias("regex"), V.parse_vector(rest).alias("qvec"))
    return got.filter((F.col("regex") != "") & (F.size("qvec") > 0) & F.forall("qvec", lambda x: x.isNotNull()))


def format_queries(queries: DataFrame, separator: str = " ") -> DataFrame:
    """(qid, value): inverse of parse_queries; vectors are rounded to six decimals."""
    return queries.select("qid", F.concat("regex", F.lit(separator), V.format_vector(F.col("qvec"))).alias("value"))


def dimensions(queries: DataFrame) -> int:
    """The one dimension of all query vectors; ValueError where they differ, 0 where there is no query."""
    got = [r[0] for r in queries.select(F.size("qvec")).distinct().limit(2).collect()]
    if len(got) > 1:
        raise ValueError("query vectors differ in dimension")
    return got[0] if got else 0


def format_results(queries: DataFrame, result: DataFrame) -> DataFrame:
    """(qid, value): ids in rank order, blank separated; an empty line for a query without results."""
    lists = result.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r"))
    ids = F.array_join(F.transform("r", lambda s: s["id"].cast("string")), " ")
    return queries.select("qid").distinct().join(lists, "qid", "left").select("qid", F.coalesce(ids, F.lit("")).alias("value"))


def parse_results(lines: DataFrame) -> DataFrame:
    """(qid, rank, id) of (id, value) lines."""
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    return lines.select(F.col("id").alias("qid"), F.posexplode(parts).alias("p", "v")).select("qid", (F.col("p") + 1).cast("long").alias("rank"), F.col("v").cast("long").alias("id"))
