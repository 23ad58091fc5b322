"""A mixture of sources with target shares of the tokens, by pivotal rounding of fractional copies.

A source's documents all get the same expected number of copies, min(target / own tokens, max_repeats). The whole part
is certain; the fractional part is rounded by the pivotal method: two fractional units meet, mass moves from one to the
other at random so that each keeps its expectation and one of them becomes 0 or 1, and the one left fractional meets
the next. Units meet in order of size, so a copy lost is made up by one of nearly the same number of tokens. Blocks of
documents do this on their own and leave one residual unit each; residuals meet in a tree, fan_in blocks at a time.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.session import BROADCAST_LIMIT, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Documents of a block, and residuals that meet at one node of the tree.
BLOCK_ROWS, FAN_IN = 20_000, 64
_EPS = 1e-9


def source_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def with_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): source trimmed and lower-cased, tokens of the whole text. Documents without a text
    have none to give and are left out; those without a source belong to no target and are left out too. tokenizer: path
    of a vocabulary file that the driver can read; tasks get its content."""
    with open(tokenizer, "rb") as f:
        content = f.read()
    if len(content) > BROADCAST_LIMIT:
        raise ValueError(f"{tokenizer}: {len(content) >> 20} MB go to no task")
    shared = documents.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_buffer(shared.value)
        t.encode_special_tokens = True
        for pdf in batches:
            n = []
            for i in range(0, len(pdf), 500):
                n += [len(e) for e in t.encode_batch_fast(list(pdf.text.iloc[i : i + 500]), add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source, "tokens": np.array(n, "i8")})

    plain = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").filter("text is not null and source is not null and doc_id is not null")
    return plain.mapInPandas(run, "doc_id long, source string, tokens long")


def plan(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, max_repeats, own_tokens, docs, target_tokens, ratio, copies, outcome), a row per target.

    target_tokens is the weight times all tokens of the listed sources. outcome: cut with a ratio of at most 1,
    repeated up to max_repeats, else capped. A listed source without tokens is capped unless its target is 0.
    """
    t = targets.select(source_name(F.col("source")).alias("source"), "weight", "max_repeats")
    own = counted.groupBy("source").agg(F.sum("tokens").alias("own_tokens"), F.count("*").alias("docs"))
    both = t.join(own, "source", "left").fillna(0, ["own_tokens", "docs"])
    total = both.agg(F.sum("own_tokens").alias("all_tokens"))
    goal = F.col("weight") * F.col("all_tokens")
    ratio = F.when(goal == 0, F.lit(0.0)).when(F.col("own_tokens") > 0, goal / F.col("own_tokens")).otherwise(F.lit(float("inf")))
    out = both.join(F.broadcast(total)).withColumn("target_tokens", goal).withColumn("ratio", ratio).drop("all_tokens")
    outcome = F.when(F.col("ratio") <= 1, "cut").when(F.col("ratio") <= F.col("max_repeats"), "repeated").otherwise("capped")
    return out.withColumn("copies", F.least("ratio", F.col("max_repeats").cast("double"))).withColumn("outcome", outcome)


def pivotal(p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """(values, at): p rounded to 0 or 1 one after another; at is the unit left fractional, -1 where none is."""
    out, at = p.copy(), -1
    draws = rng.random(len(p))
    for j in range(len(p)):
        q = out[j]
        if q < _EPS or q > 1 - _EPS:
            out[j] = round(q)
            continue
        if at < 0:
            at = j
            continue
        a, s = out[at], out[at] + q
        if s < 1 - _EPS:  # one of the two gives all it has
            if draws[j] * s < a:
                out[at], out[j] = s, 0.0
            else:
                out[at], out[j], at = 0.0, s, j
        elif s <= 1 + _EPS:  # exactly one of the two
            win = draws[j] < a
            out[at], out[j], at = float(win), float(not win), -1
        elif draws[j] * (2 - s) < 1 - q:
            out[at], out[j], at = 1.0, s - 1, j
        else:
            out[at], out[j] = s - 1, 1.0
    return out, at


_UNIT = "source string, doc_id long, tokens long, base long, p double, node long, done boolean"


def _round(seed: int, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], kind="stable").reset_index(drop=True)
        key = [seed, level, int(pdf.node.iloc[0]), *pdf.source.iloc[0].encode()]
        rng = np.random.default_rng(key)
        p, at = pivotal(pdf.p.to_numpy(float), rng)
        if at >= 0 and last:
            p[at], at = float(rng.random() < p[at]), -1
        return pdf.assign(p=p, done=np.arange(len(pdf)) != at)

    return run


def mixture(counted: DataFrame, planned: DataFrame, seed: int = 7, block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(source, doc_id, tokens, copies) for every document of a listed source, copies 0 included; the same in every run
    for a seed. counted: of with_tokens; planned: of plan. No document has more copies than its source's max_repeats,
    and the copies of a source differ from their expected number by less than one."""
    p = planned.select("source", "copies", F.ceil(F.col("docs") / block_rows).alias("blocks"))
    unit = counted.join(F.broadcast(p), "source").select(
        "source", "doc_id", "tokens", F.floor("copies").alias("base"), (F.col("copies") - F.floor("copies")).alias("p"),
        F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("node"), F.lit(False).alias("done"),
    )
    blocks = planned.agg(F.max(F.ceil(F.col("docs") / block_rows))).first()[0] or 1
    level, out = 0, None
    while True:
        last = blocks <= 1
        got = written(unit.groupBy("source", "node").applyInPandas(_round(seed, level, last), _UNIT), f"mix-{level}")
        ready = got.filter("done").select("source", "doc_id", "tokens", (F.col("base") + F.round("p").cast("long")).alias("copies"))
        out = ready if out is None else out.unionByName(ready)
        if last:
            return out
        unit = got.filter("not done").withColumn("node", F.floor(F.col("node") / fan_in))
        blocks, level = -(-blocks // fan_in), level + 1


def report(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """(source, outcome, weight, share, tokens, copies, fewest_copies, most_copies): shares really reached, of the
    mixture's tokens, and the outcome that the copies drawn show: capped where every document has as many as allowed and
    the target is still not reached, cut where none has more than one, else repeated. A source without documents is
    capped unless its target is 0."""
    got = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("copies"), F.min("copies").alias("fewest_copies"), F.max("copies").alias("most_copies")
    )
    total = got.agg(F.sum("tokens").alias("total"))
    rows = planned.select("source", "weight", "max_repeats", "docs", "target_tokens").join(got, "source", "left").fillna(0, ["tokens", "copies", "fewest_copies", "most_copies"]).join(F.broadcast(total))
    share = F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(F.lit(0.0))
    all_used = (F.col("docs") == 0) | (F.col("fewest_copies") >= F.col("max_repeats"))
    short = F.col("tokens") < F.col("target_tokens") * (1 - 1e-9)
    outcome = F.when(all_used & short, "capped").when(F.col("most_copies") <= 1, "cut").otherwise("repeated")
    return rows.select("source", outcome.alias("outcome"), "weight", share.alias("share"), "tokens", "copies", "fewest_copies", "most_copies")


def checked(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """(source, sum_ok, cap_ok, near_ok): what a mixture promises. The copies of a source differ from their expected
    number by less than one; none is above its cap or more than one away from the expectation of a document; its tokens
    differ from those expected by no more than one in a hundred and its longest document."""
    got = mixed.groupBy("source").agg(
        F.sum("copies").alias("n"), F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("copies").alias("most"), F.min("copies").alias("fewest"), F.max("tokens").alias("longest")
    )
    rows = planned.join(got, "source", "left").fillna(0, ["n", "t", "most", "fewest", "longest"])
    want, tokens = F.col("copies") * F.col("docs"), F.col("copies") * F.col("own_tokens")
    inside = (F.col("most") <= F.least(F.ceil("copies"), F.col("max_repeats"))) & ((F.col("docs") == 0) | (F.col("fewest") >= F.floor("copies")))
    return rows.select(
        "source", ((F.col("docs") == 0) | (F.abs(F.col("n") - want) < 1 + 1e-6)).alias("sum_ok"), inside.alias("cap_ok"),
        ((F.col("docs") == 0) | (F.abs(F.col("t") - tokens) <= 0.01 * tokens + F.col("longest"))).alias("near_ok"),
    )
