"""Per-key results where a few keys hold most rows: aggregation over a tree.

Per key: its rows, its distinct ids and the id with most of its rows. No task ever receives a key alone, nor all
partial states of one:

  leaves   the input is cut to chunks of CHUNK_ROWS rows where it lies, and each chunk is folded there to one state a key
  level i  states of fan_in neighbouring nodes are joined, until one node is left: what meets at a node are at most
           fan_in states of a few numbers, each of which can be merged in any order, whatever the rows behind them

Counts of rows fold over chunks as they are. The id with most rows needs the complete count of each (key, id) first, and
those are spread by key and id, so a hot key lies on all tasks; each of them is a leaf that folds its counts to one
state a key, and the tree goes on from there.

Repeated rows count as often as they occur. Null keys are left out and counted nowhere; null ids count as rows and as
no id; a key with null ids only has a null top_id. Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.session import small, written

#: Rows of a leaf chunk, and nodes joined to one at each level.
CHUNK_ROWS, FAN_IN = 100_000, 8


def levels(nodes: int, fan_in: int = FAN_IN) -> int:
    """Rounds until one node is left: logarithmic in the nodes."""
    n = 1
    while fan_in**n < nodes:
        n += 1
    return n


def folded(states: DataFrame, by: list[str], merge: dict[str, Column], nodes: int, fan_in: int = FAN_IN) -> DataFrame:
    """(*by, *merge): states (*by, node, *merge) of nodes 0 to nodes - 1 joined fan_in at a time up to the root. merge:
    the aggregate that merges each column of a state."""
    for _ in range(levels(nodes, fan_in)):
        states = states.withColumn("node", F.floor(F.col("node") / fan_in)).groupBy(*by, "node").agg(*[f.alias(c) for c, f in merge.items()])
    return states.drop("node")


def keyed(df: DataFrame, group: list[str], keys: list[str], id_col: str) -> DataFrame:
    """(*group, key_name, key_value, id): each row once for every key of it that is not null, in one read."""
    each = F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("key_value")) for k in keys])
    return df.select(*group, F.inline(each), F.col(id_col).alias("id")).filter("key_value is not null")


def counts(df: DataFrame, group: list[str], keys: list[str], id_col: str, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(*group, key_name, key_value, rows) by chunks and tree, all keys in one read of the input."""
    place = F.monotonically_increasing_id()  # partition and row in it
    chunked = df.select(*group, *keys, id_col, F.shiftrightunsigned(place, 33).alias("_part"), F.floor(place.bitwiseAND((1 << 33) - 1) / chunk_rows).alias("_chunk"))
    by = [*group, "key_name", "key_value"]
    leaves = written(keyed(chunked, [*group, "_part", "_chunk"], keys, id_col).groupBy(*by, "_part", "_chunk").agg(F.count("*").alias("rows")), "leaves")
    most = leaves.agg(F.max("_part").alias("p"), F.max("_chunk").alias("c")).first()
    width = 1 + (most.p or 0)
    states = leaves.select(*by, (F.col("_chunk") * width + F.col("_part")).alias("node"), "rows")
    return folded(states, by, {"rows": F.sum("rows")}, width * (1 + (most.c or 0)), fan_in)


def per_key(rows: DataFrame, group: list[str], fan_in: int = FAN_IN) -> DataFrame:
    """(*group, key_name, key_value, rows, ids, top_id, top_rows) of rows as keyed gives them. Of ids with equally many
    rows the smallest is top_id."""
    nodes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*group, "key_name", "key_value"]
    cells = rows.groupBy(*by, "id").agg(F.count("*").alias("n"))
    best = F.struct(F.col("n"), (-F.col("id")).alias("neg"))
    states = (
        cells.withColumn("node", F.pmod(F.spark_partition_id(), F.lit(nodes)))
        .groupBy(*by, "node")
        .agg(F.sum("n").alias("rows"), F.count("id").alias("ids"), F.max(F.when(F.col("id").isNotNull(), best)).alias("best"))
    )
    out = folded(states, by, {"rows": F.sum("rows"), "ids": F.sum("ids"), "best": F.max("best")}, nodes, fan_in)
    return out.select(*by, "rows", "ids", (-F.col("best.neg")).alias("top_id"), F.col("best.n").alias("top_rows"))


def heavy(df: DataFrame, group: list[str], shares: dict[str, int], id_col: str, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """per_key of the keys that hold at least 1/shares[key] of their group's rows with that key, with the group's total.

    Rows of all keys are counted through the tree in one read; at most shares[key] keys of a group can be heavy, and only
    their rows are read again for the ids.
    """
    keys = list(shares)
    found = written(counts(df, group, keys, id_col, chunk_rows, fan_in), "key-counts")
    totals = found.groupBy(*group, "key_name").agg(F.sum("rows").alias("total"))
    least = F.element_at(F.create_map(*[x for k, n in shares.items() for x in (F.lit(k), F.lit(n))]), F.col("key_name"))
    hot = found.join(totals, [*group, "key_name"]).filter(F.col("rows") * least >= F.col("total"))
    hot = small(written(hot.select(*group, "key_name", "key_value", "total"), "hot-keys"))
    rows = keyed(df, group, keys, id_col).join(hot, [*group, "key_name", "key_value"], "left_semi")
    return per_key(rows, group, fan_in=fan_in).join(hot, [*group, "key_name", "key_value"])
