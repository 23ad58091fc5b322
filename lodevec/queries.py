"""The queries over the driver's tables, each with its SQL twin where SQL can say it.

The corpus is `items` (searches stay within a build), or `embeddings` joined with `part` names where an index over one
collection is wanted. Searches take every row whose id is divisible by 100 as a query, against all rows. Trained parts
have deterministic stand-ins where the SQL twin needs them: the first vectors serve as centroids or code words.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodevec.functions import text as T
from lodevec.functions import vector as V
from lodevec.operators import cluster, evaluate, exact, gramindex, graph, heavykeys, pq, search, sweep, workload
from lodevec.plans import regexplan
from lodevec.session import checkpoint_dir, small, table, written
from lodevec.sources import binary, store, textio

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}
DIM, K = 64, 10
PATTERNS = ["vector", "graph|tree", "^the", "light$", "the.*of", "a.*on|on.*a", "[aeiou]{3}", "(red|blue|green) .*"]
P_PATTERNS = ["red|blue", "small.*ring", "^hot", "steel$", "e.*d", "green"]
N_CENTROIDS, PQ_M, PQ_K = 16, 8, 16


def query(name: str, sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --- corpora -----------------------------------------------------------------------------------------------------


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("id", "build_id", F.col("text").alias("str"), F.col("embedding").alias("vec"))


def item_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every item whose id is divisible by 100, with one of the patterns."""
    pattern = F.get(F.array(*map(F.lit, PATTERNS)), F.pmod(F.floor(F.col("id") / 100), F.lit(len(PATTERNS))).cast("int"))
    got = items(spark, d).filter((F.col("id") % 100 == 0) & V.usable(F.col("vec"), DIM))
    return got.select(F.col("id").alias("qid"), "build_id", pattern.alias("regex"), F.col("vec").alias("qvec"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    e, p = table(spark, d, "embeddings"), table(spark, d, "part")
    return e.join(p, e.vec_id == p.p_partkey).select(F.col("vec_id").alias("id"), F.col("p_name").alias("str"), F.col("embedding").alias("vec"))


def part_queries(spark: SparkSession, d: str) -> DataFrame:
    pattern = F.get(F.array(*map(F.lit, P_PATTERNS)), F.pmod(F.floor(F.col("id") / 100), F.lit(len(P_PATTERNS))).cast("int"))
    return parts(spark, d).filter("id % 100 = 0").select(F.col("id").alias("qid"), pattern.alias("regex"), F.col("vec").alias("qvec"))


def centroids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").filter(F.col("vec_id") < N_CENTROIDS)
    return e.select(F.col("vec_id").cast("int").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("centroid"))


def codebook(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").filter(F.col("vec_id") < PQ_K).select(F.col("vec_id").cast("int").alias("code"), F.col("embedding").cast("array<double>").alias("v"))
    each = e.select("code", F.posexplode(F.array(*[V.sub_vector(F.col("v"), s, DIM // PQ_M) for s in range(PQ_M)])).alias("sub", "centroid"))
    return each.select("sub", "code", "centroid")


def membership(spark: SparkSession, d: str) -> DataFrame:
    return cluster.assign(parts(spark, d), centroids(spark, d))


def cluster_grams(spark: SparkSession, d: str) -> DataFrame:
    return gramindex.gram_index(parts(spark, d).join(membership(spark, d).select("id", "cluster_id"), "id"), "cluster_id")


def node_grams(spark: SparkSession, d: str) -> DataFrame:
    return gramindex.gram_index(parts(spark, d), "id")


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("dist", F.round("dist", 6))


# --- SQL parts ---------------------------------------------------------------------------------------------------


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_OK = "({0} IS NOT NULL AND len({0}) = {1} AND len(list_filter({0}, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0)"
_ITEMS = f"corpus AS (SELECT id, build_id, text AS str, embedding::DOUBLE[] AS vec FROM items WHERE {_OK.format('embedding', DIM)})"
_ITEM_Q = f"q AS (SELECT id AS qid, build_id, {_list(PATTERNS)}[(id // 100) % {len(PATTERNS)} + 1] AS regex, vec AS qvec FROM corpus WHERE id % 100 = 0)"
_PARTS = "corpus AS (SELECT vec_id AS id, p_name AS str, embedding::DOUBLE[] AS vec FROM embeddings JOIN part ON vec_id = p_partkey)"
_PART_Q = f"q AS (SELECT id AS qid, {_list(P_PATTERNS)}[(id // 100) % {len(P_PATTERNS)} + 1] AS regex, vec AS qvec FROM corpus WHERE id % 100 = 0)"
_CENTROIDS = f"centroids AS (SELECT vec_id::INT AS cluster_id, embedding::DOUBLE[] AS centroid FROM embeddings WHERE vec_id < {N_CENTROIDS})"
_MEMBER = "member AS (SELECT id, cluster_id, dist FROM (SELECT id, cluster_id, list_distance(vec, centroid) AS dist, row_number() OVER (PARTITION BY id ORDER BY list_distance(vec, centroid), cluster_id) AS r FROM corpus, centroids) WHERE r = 1)"
_BOOK = f"book AS (SELECT s::INT AS sub, vec_id::INT AS code, (embedding::DOUBLE[])[s * 8 + 1 : s * 8 + 8] AS centroid FROM embeddings, range({PQ_M}) t(s) WHERE vec_id < {PQ_K})"
_CODES = "codes AS (SELECT id, sub, code FROM (SELECT id, sub, code, row_number() OVER (PARTITION BY id, sub ORDER BY list_distance(vec[sub * 8 + 1 : sub * 8 + 8], centroid), code) AS r FROM corpus, book) WHERE r = 1)"
_PRE = r"regexp_replace(lower(regexp_replace({0}, '[^A-Za-z\s\x0b]', '', 'g')), '[\s\x0b]', ' ', 'g')"
_GRAMS = "list_transform(range(1, greatest(len({0}) - 1, 1)), lambda i: {0}[i:i+2])"
_TOP = "SELECT qid, rank, id, round(dist, 6) AS dist FROM (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM {0}) WHERE rank <= {1}"
_D = "list_distance(vec, qvec)"
_HIT = "regexp_matches(str, regex, 'i')"
_GT = f"hits AS (SELECT qid, id, {_D} AS dist FROM corpus JOIN q USING (build_id) WHERE {_HIT})"
_PGT = f"hits AS (SELECT qid, id, {_D} AS dist FROM corpus, q WHERE {_HIT})"

# --- exact search ------------------------------------------------------------------------------------------------


@query("groundtruth_topk", f"WITH {_PARTS}, q AS (SELECT vec AS qvec FROM corpus WHERE id = 7) SELECT id, round({_D}, 6) AS dist FROM corpus, q WHERE regexp_matches(str, 'red|blue', 'i') ORDER BY {_D}, id LIMIT {K}")
def groundtruth_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = parts(spark, d)
    return rounded(exact.topk(rows, "red|blue", rows.filter("id = 7").first().vec, K))


@query("groundtruth_batch", f"WITH {_ITEMS}, {_ITEM_Q}, {_GT} {_TOP.format('hits', K)}")
def groundtruth_batch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exact.groundtruth(items(spark, d), item_queries(spark, d), K))


@query("prefilter_exact", SQL["groundtruth_batch"])
def prefilter_exact(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exact.prefilter(items(spark, d), item_queries(spark, d), K, 1.0))


@query("prefilter_sampled", f"WITH {_ITEMS}, {_ITEM_Q}, {_GT} SELECT qid, least(count(*), {K}) AS rows, true AS inside FROM hits GROUP BY qid")
def prefilter_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Of each query the rows found in a half of its matches, and whether all of them are matches at their distance."""
    rows, q = items(spark, d), item_queries(spark, d)
    got = exact.prefilter(rows, q, K, 0.5)
    every = exact.groundtruth(rows, q, rows.count()).select("qid", "id", F.col("dist").alias("true_dist"))
    both = got.join(every, ["qid", "id"], "left")
    return both.groupBy("qid").agg(F.count("*").alias("rows"), F.every(F.coalesce(F.col("dist") == F.col("true_dist"), F.lit(False))).alias("inside"))


@query("postfilter_unlimited", SQL["groundtruth_batch"])
def postfilter_unlimited(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exact.postfilter(items(spark, d), item_queries(spark, d), K))


@query("postfilter_capped", f"WITH {_ITEMS}, {_ITEM_Q}, near AS (SELECT * FROM (SELECT qid, id, str, regex, {_D} AS dist, row_number() OVER (PARTITION BY qid ORDER BY {_D}, id) AS r FROM corpus JOIN q USING (build_id)) WHERE r <= {K * 10}), hits AS (SELECT * FROM near WHERE {_HIT}) {_TOP.format('hits', K)}")
def postfilter_capped(spark: SparkSession, d: str) -> DataFrame:
    return rounded(exact.postfilter(items(spark, d), item_queries(spark, d), K, 10, 10))


@query("regex_match_count", "SELECT p.n::BIGINT AS qid, count(*) FILTER (WHERE regexp_matches(text, p.p, 'i')) AS matches FROM items, (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(PATTERNS)) + ") p(n, p) GROUP BY ALL")
def regex_match_count(spark: SparkSession, d: str) -> DataFrame:
    return exact.match_counts(items(spark, d), dict(enumerate(PATTERNS)))


@query("regex_case_sensitive", SQL["regex_match_count"].replace(", 'i'", ""))
def regex_case_sensitive(spark: SparkSession, d: str) -> DataFrame:
    return exact.match_counts(items(spark, d), dict(enumerate(PATTERNS)), case_sensitive=True)


@query("regex_invalid", "SELECT 0::BIGINT AS qid, 0::BIGINT AS rank, 0::BIGINT AS id, 0.0::DOUBLE AS dist FROM items WHERE false")
def regex_invalid(spark: SparkSession, d: str) -> DataFrame:
    q = part_queries(spark, d).withColumn("regex", F.lit("(unclosed"))
    return exact.groundtruth(parts(spark, d), q, K)


#: Constructs over texts with mixed line ends, which both engines and the SQL twin must take alike.
DIALECT = ["the.index", "s.$", r"\.$", r"^In\b", r"\r", r"t.\n", "[[:digit:]]+ MB", "(?P<first>o)n", "[^a-z ]{3}", r"\bof\b", r"[[:upper:]]{4}", "e{2}"]


@query("regex_dialect", "SELECT way, n::BIGINT AS qid, count(*) FILTER (WHERE regexp_matches(text, p, 'i')) AS matches FROM documents, (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(DIALECT)) + ") p(n, p), (VALUES ('few'), ('many')) w(way) GROUP BY ALL")
def regex_dialect(spark: SparkSession, d: str) -> DataFrame:
    """The same patterns counted as expressions, and among so many others that Python counts them."""
    texts = table(spark, d, "documents").select(F.col("text").alias("str"))
    few = dict(enumerate(DIALECT))
    many = few | {1000 + i: f"nosuch{i}" for i in range(exact.EXPRESSIONS)}
    each = [exact.match_counts(texts, p).filter(F.col("qid") < 1000).withColumn("way", F.lit(way)) for way, p in (("few", few), ("many", many))]
    return each[0].unionByName(each[1])


def _metric(name: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(exact.groundtruth(items(spark, d), item_queries(spark, d), K, name))

    query(f"topk_{name}", f"WITH {_ITEMS}, {_ITEM_Q}, {_GT.replace(_D, sql)} {_TOP.format('hits', K)}")(run)


_metric("l2", _D)
_metric("ip", "-list_inner_product(vec, qvec)")
_metric("cosine", "1 - list_inner_product(vec, qvec) / sqrt(list_inner_product(vec, vec)) / sqrt(list_inner_product(qvec, qvec))")

# --- texts and vectors -------------------------------------------------------------------------------------------


@query("preprocess_text", f"SELECT id, {_PRE.format('text')} AS pre, regexp_replace({_PRE.format('text')}, ' ', '', 'g') AS letters FROM items")
def preprocess_text(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", T.preprocess(F.col("str")).alias("pre"), T.preprocess_letters(F.col("str")).alias("letters"))


@query("clean_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query("extract_words", "SELECT id, array_to_string(list_transform(list_filter(regexp_extract_all(text, '([A-Za-z]+)', 1), lambda w: len(w) >= 3), lambda w: lower(w)), ' ') AS words FROM items")
def extract_words(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", F.array_join(T.extract_words(F.col("str")), " ").alias("words"))


@query("dblp_title_extract", "SELECT id, regexp_extract('<title>' || text || '</title>', '<title>(.*?)</title>', 1) AS title FROM items")
def dblp_title_extract(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("<title>"), F.col("str"), F.lit("</title>"))
    return items(spark, d).select("id", T.title_of(line).alias("title"))


@query("html_unescape", r"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), '&#39;', chr(39)), '&amp;', '&'), '[^a-zA-Z ]', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM documents")
def html_unescape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean_text(T.unescape_html("text")).alias("clean"))


@query("blank_rejected", "SELECT id, text FROM items WHERE coalesce(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) NOT IN ('', 'untitled', 'nan'), false)".replace("\\\\", "\\"))
def blank_rejected(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").filter(~T.is_blank(F.col("text"), ("untitled", "nan"))).select("id", "text")


@query("concat_fields", "SELECT id, concat_ws(' - ', dataset, text) AS name FROM items")
def concat_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("id", F.concat_ws(" - ", "dataset", "text").alias("name"))


@query("distinct_titles", "SELECT text AS str, min(id) AS first FROM items GROUP BY text")
def distinct_titles(spark: SparkSession, d: str) -> DataFrame:
    return workload.distinct_first(items(spark, d), "str", "id")


@query("vector_usable", f"SELECT id, {_OK.format('embedding', DIM)} AS usable FROM items")
def vector_usable(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", V.usable(F.col("vec"), DIM).alias("usable"))


@query("length_check", f"SELECT count(*) AS rows, count(text) AS texts, count(*) FILTER (WHERE {_OK.format('embedding', DIM)}) AS vectors FROM items")
def length_check(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).agg(F.count("*").alias("rows"), F.count("str").alias("texts"), F.count_if(V.usable(F.col("vec"), DIM)).alias("vectors"))


@query("vector_slices", f"WITH {_ITEMS} SELECT id, s::INT AS sub, round(list_sum(list_transform(vec[s * 8 + 1 : s * 8 + 8], lambda x: x * x)), 6) AS sq FROM corpus, range(8) t(s)")
def vector_slices(spark: SparkSession, d: str) -> DataFrame:
    good = items(spark, d).filter(V.usable(F.col("vec"), DIM))
    each = good.select("id", F.posexplode(F.array(*[V.sub_vector(F.col("vec"), s, 8) for s in range(8)])).alias("sub", "v"))
    return each.select("id", "sub", F.round(V.inner_product(F.col("v"), F.col("v")), 6).alias("sq"))


# --- trigram indexes and plans -----------------------------------------------------------------------------------

_NODE_GRAMS = f"ng AS (SELECT DISTINCT id, unnest({_GRAMS.format('p')}) AS gram FROM (SELECT id, {_PRE.format('str')} AS p FROM corpus) WHERE len(p) >= 3)"
_CLUSTER_GRAMS = f"cg AS (SELECT DISTINCT cluster_id, gram FROM ({{0}}) JOIN member USING (id))".format("SELECT * FROM ng")
_ITEM_GRAMS = _NODE_GRAMS.replace("FROM corpus", "FROM (SELECT id, text AS str FROM items)")


@query("trigram_index_nodes", f"WITH {_ITEM_GRAMS} SELECT gram, id FROM ng")
def trigram_index_nodes(spark: SparkSession, d: str) -> DataFrame:
    return gramindex.gram_index(items(spark, d), "id")


@query("trigram_index_clusters", f"WITH {_PARTS}, {_CENTROIDS}, {_MEMBER}, {_NODE_GRAMS}, {_CLUSTER_GRAMS} SELECT gram, cluster_id FROM cg")
def trigram_index_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster_grams(spark, d)


@query("gram_posting_stats", f"WITH {_ITEM_GRAMS} SELECT gram, count(DISTINCT id) AS postings FROM ng GROUP BY gram")
def gram_posting_stats(spark: SparkSession, d: str) -> DataFrame:
    return gramindex.posting_stats(gramindex.gram_index(items(spark, d), "id"), "id")


#: Patterns and, worked out by hand, the trigrams a match must hold: any of the lists, all of a list; None where nothing
#: is certain. The planner is held against these.
_CAND = {
    "graph|tree": [["gra", "rap", "aph"], ["tre", "ree"]],
    "vector.*hash": [["vec", "ect", "cto", "tor", "has", "ash"]],
    "(red|blue).*light": [["red", "lig", "igh", "ght"], ["blu", "lue", "lig", "igh", "ght"]],
    "ab": None,
    "colou?r": [["col", "olo"]],
    "(tree){0,3}": None,
    "[a-z]+approach$": [["app", "ppr", "pro", "roa", "oac", "ach"]],
    "(learned|exact) (tree|hash)": [["lea", "ear", "arn", "rne", "ned", "tre", "ree"], ["lea", "ear", "arn", "rne", "ned", "has", "ash"], ["exa", "xac", "act", "tre", "ree"], ["exa", "xac", "act", "has", "ash"]],
    "river lies": [["riv", "ive", "ver", "er ", "r l", " li", "lie", "ies"]],
    "cover2tree": [["cov", "ove", "ver", "tre", "ree"]],
}
_P_PLAN = {
    "red|blue": [["red"], ["blu", "lue"]], "small.*ring": [["sma", "mal", "all", "rin", "ing"]], "^hot": [["hot"]], "steel$": [["ste", "tee", "eel"]], "e.*d": None, "green": [["gre", "ree", "een"]],
}


def _held(key: str, table_: str, all_: list[str]) -> str:
    return f"SELECT {key} FROM {table_} WHERE gram IN ({', '.join(map(repr, all_))}) GROUP BY {key} HAVING count(*) = {len(all_)}"


_CAND_SQL = " UNION ".join(
    f"SELECT {q}::BIGINT AS qid, id FROM items" if plan is None else " UNION ".join(f"SELECT {q}::BIGINT AS qid, id FROM ({_held('id', 'ng', c)})" for c in plan) for q, plan in enumerate(_CAND.values())
)


@query("candidates_dnf", f"WITH {_ITEM_GRAMS} {_CAND_SQL}")
def candidates_dnf(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d)
    return gramindex.candidates(regexplan.dnf_frame(spark, dict(enumerate(_CAND))), gramindex.gram_index(rows, "id"), "id", rows)


@query("candidates_conjunction", f"WITH {_ITEM_GRAMS} SELECT 0::BIGINT AS qid, id FROM ng WHERE gram IN ('vec', 'ect', 'cto', 'tor') GROUP BY id HAVING count(*) = 4")
def candidates_conjunction(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d)
    return gramindex.candidates(regexplan.dnf_frame(spark, {0: "vector"}), gramindex.gram_index(rows, "id"), "id", rows)


def _may(pattern: str, keys: str, grams: str, key: str) -> str:
    plan = _P_PLAN[pattern]
    if plan is None:
        return f"SELECT qid, {key} FROM q, {keys} WHERE regex = '{pattern}'"
    return " UNION ".join(f"SELECT qid, {key} FROM q, ({_held(key, grams, c)}) WHERE regex = '{pattern}'" for c in plan)


_MAY_CLUSTER = "may AS (" + " UNION ".join(_may(p, "centroids", "cg", "cluster_id") for p in P_PATTERNS) + ")"
_INDEX = f"{_PARTS}, {_PART_Q}, {_CENTROIDS}, {_MEMBER}, {_NODE_GRAMS}, {_CLUSTER_GRAMS}, {_MAY_CLUSTER}"


@query("candidate_clusters", f"WITH {_INDEX} SELECT qid, cluster_id FROM may")
def candidate_clusters(spark: SparkSession, d: str) -> DataFrame:
    return search.candidate_clusters(part_queries(spark, d), cluster_grams(spark, d), centroids(spark, d))


# --- clusters ----------------------------------------------------------------------------------------------------


@query("kmeans_assign", f"WITH {_PARTS}, {_CENTROIDS}, {_MEMBER} SELECT id, cluster_id, round(dist, 6) AS dist FROM member")
def kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    return rounded(membership(spark, d))


@query("kmeans_update", f"WITH {_PARTS}, {_CENTROIDS}, {_MEMBER} SELECT cluster_id, pos::INT AS pos, round(avg(vec[pos + 1]), 6) AS x FROM corpus JOIN member USING (id), range({DIM}) t(pos) GROUP BY ALL")
def kmeans_update(spark: SparkSession, d: str) -> DataFrame:
    new = cluster.update(parts(spark, d), membership(spark, d))
    return new.select("cluster_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("cluster_sizes", "SELECT build_id, cluster_id, count(*) AS members FROM membership WHERE cluster_id IS NOT NULL GROUP BY ALL")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "membership").filter("cluster_id is not null")
    return m.groupBy("build_id", "cluster_id").agg(F.count("*").alias("members"))


@query("cluster_rank_nprobe", f"WITH {_PARTS}, {_PART_Q}, {_CENTROIDS} SELECT qid, cluster_id, round(dist, 6) AS dist, rank FROM (SELECT qid, cluster_id, list_distance(centroid, qvec) AS dist, row_number() OVER (PARTITION BY qid ORDER BY list_distance(centroid, qvec), cluster_id) AS rank FROM q, centroids) WHERE rank <= 4")
def cluster_rank_nprobe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.rank_clusters(part_queries(spark, d), centroids(spark, d), 4))


@query("cluster_listing", f"WITH {_PARTS}, {_CENTROIDS}, {_MEMBER} SELECT cluster_id, id // 1000 AS part, count(*) AS members, string_agg(id::VARCHAR, ' ' ORDER BY id) AS ids FROM member GROUP BY cluster_id, id // 1000")
def cluster_listing(spark: SparkSession, d: str) -> DataFrame:
    return store.listing(membership(spark, d))


@query("kmeans_trained", f"WITH {_PARTS} SELECT {N_CENTROIDS}::BIGINT AS clusters, count(*) AS rows, true AS nearer FROM corpus")
def kmeans_trained(spark: SparkSession, d: str) -> DataFrame:
    """Clusters, rows in them, and whether rows lie nearer their centroids than after no iteration."""
    rows = parts(spark, d)
    trained, start = (cluster.assign(rows, written(cluster.kmeans(rows, N_CENTROIDS, n), "centroids")) for n in (10, 0))
    before = start.agg(F.avg(F.col("dist") ** 2).alias("before"))
    return trained.agg(F.count_distinct("cluster_id").alias("clusters"), F.count("*").alias("rows"), F.avg(F.col("dist") ** 2).alias("after")).join(before).select("clusters", "rows", (F.col("after") < F.col("before")).alias("nearer"))


def _facts(rows: DataFrame, q: DataFrame, got: DataFrame, least: float) -> DataFrame:
    """Queries, whether every row found is a match at its distance, and whether mean recall is at least `least`."""
    got = written(got, "found")
    every = exact.groundtruth(rows, q, rows.count()).select("qid", "id", F.col("dist").alias("true_dist"))
    right = got.join(every, ["qid", "id"], "left").agg(F.coalesce(F.every(F.coalesce(F.abs(F.col("dist") - F.col("true_dist")) < 1e-9, F.lit(False))), F.lit(True)).alias("right"))
    s = evaluate.summary(evaluate.recall(q, exact.groundtruth(rows, q, K), got, K))
    return s.join(right).select("queries", "right", (F.col("mean_recall") >= least).alias("enough"))


_FACTS = f"WITH {_PARTS}, {_PART_Q} SELECT count(*) AS queries, true AS \"right\", true AS enough FROM q"


# --- quantisation ------------------------------------------------------------------------------------------------


@query("pq_encode", f"WITH {_PARTS}, {_BOOK}, {_CODES} SELECT id, sub, code FROM codes")
def pq_encode(spark: SparkSession, d: str) -> DataFrame:
    codes = pq.encode(parts(spark, d), codebook(spark, d))
    return codes.select("id", F.posexplode("code").alias("sub", "code")).withColumn("code", F.col("code").cast("int"))


_LUT = "lut AS (SELECT qid, sub, code, pow(list_distance(centroid, qvec[sub * 8 + 1 : sub * 8 + 8]), 2) AS d2 FROM q, book)"


@query("pq_dist_table", f"WITH {_PARTS}, {_PART_Q}, {_BOOK}, {_LUT} SELECT qid, sub, code, round(d2, 6) AS d2 FROM lut")
def pq_dist_table(spark: SparkSession, d: str) -> DataFrame:
    return pq.distance_table(part_queries(spark, d), codebook(spark, d), DIM // PQ_M).withColumn("d2", F.round("d2", 6))


@query("pq_adc", f"WITH {_PARTS}, {_PART_Q}, {_BOOK}, {_CODES}, {_LUT} SELECT qid, id, round(sum(d2), 6) AS adc FROM codes JOIN lut USING (sub, code) GROUP BY ALL")
def pq_adc(spark: SparkSession, d: str) -> DataFrame:
    lut = pq.distance_table(part_queries(spark, d), codebook(spark, d), DIM // PQ_M)
    rows = lut.groupBy("qid", "sub").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "d2"))), lambda s: s["d2"]).alias("t"))
    wide = rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("sub", "t"))), lambda s: s["t"]).alias("lut"))
    pairs = pq.encode(parts(spark, d), codebook(spark, d)).join(small(written(wide, "lut"), 8 * PQ_M * PQ_K))
    return pairs.select("qid", "id", F.round(pq.adc_column(F.col("code"), F.col("lut")), 6).alias("adc"))


# --- index-backed search -----------------------------------------------------------------------------------------


def _ann(spark: SparkSession, d: str, ef: int, nprobe: int) -> DataFrame:
    rows, book = parts(spark, d), codebook(spark, d)
    return search.ann(rows, part_queries(spark, d), centroids(spark, d), membership(spark, d), cluster_grams(spark, d), book, pq.encode(rows, book), K, ef, nprobe)


@query("ann_full_ef", f"WITH {_PARTS}, {_PART_Q}, {_PGT} {_TOP.format('hits', K)}")
def ann_full_ef(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_ann(spark, d, 1_000_000, 0))


@query("ann_fixed_codebook", f"WITH {_INDEX}, {_BOOK}, {_CODES}, {_LUT}, near AS (SELECT qid, cluster_id FROM (SELECT qid, cluster_id, row_number() OVER (PARTITION BY qid ORDER BY list_distance(centroid, qvec), cluster_id) AS r FROM may JOIN q USING (qid) JOIN centroids USING (cluster_id)) WHERE r <= 6), scan AS (SELECT qid, id, sum(d2 ORDER BY sub) AS adc FROM near JOIN member USING (cluster_id) JOIN corpus USING (id) JOIN q USING (qid) JOIN codes USING (id) JOIN lut USING (qid, sub, code) WHERE {_HIT} GROUP BY qid, id), pool AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(adc, 9), id) AS r FROM scan) WHERE r <= 20), hits AS (SELECT qid, id, {_D} AS dist FROM pool JOIN corpus USING (id) JOIN q USING (qid)) {_TOP.format('hits', K)}")
def ann_fixed_codebook(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_ann(spark, d, 20, 6))


@query("ann_trained", _FACTS)
def ann_trained(spark: SparkSession, d: str) -> DataFrame:
    rows = parts(spark, d)
    c = written(cluster.kmeans(rows, N_CENTROIDS, 10), "centroids")
    member = written(cluster.assign(rows, c), "membership")
    grams = gramindex.gram_index(rows.join(member.select("id", "cluster_id"), "id"), "cluster_id")
    book = written(pq.train(rows, DIM, PQ_M, 64), "codebook")
    return _facts(rows, part_queries(spark, d), search.ann(rows, part_queries(spark, d), c, member, grams, book, pq.encode(rows, book), K, 100, 12), 0.8)


@query("ann_stored", SQL["ann_fixed_codebook"])
def ann_stored(spark: SparkSession, d: str) -> DataFrame:
    """Saved, loaded and searched; the scan reads the files of its clusters."""
    rows, book = parts(spark, d), codebook(spark, d)
    path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    index = {"centroids": centroids(spark, d), "gram_index": cluster_grams(spark, d), "codebook": book, "rows": search.index_rows(rows, membership(spark, d), pq.encode(rows, book))}
    store.save(index, path, rows.count(), dim=DIM, m=PQ_M)
    at = store.load(spark, path, rows.count(), dim=DIM, m=PQ_M)
    return rounded(search.ann(rows, part_queries(spark, d), at["centroids"], None, at["gram_index"], at["codebook"], None, K, 20, 6, rows=at["rows"]))


def _hier(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stand-in levels: coarse centroids are the first 4 vectors, fine ones the first 16 under their nearest coarse."""
    c = centroids(spark, d)
    coarse = c.filter("cluster_id < 4").withColumnRenamed("cluster_id", "coarse_id")
    up = cluster.assign(c.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("vec")), c.filter("cluster_id < 4"))
    fine = c.withColumnRenamed("cluster_id", "fine_id").join(up.select(F.col("id").cast("int").alias("fine_id"), F.col("cluster_id").alias("coarse_id")), "fine_id")
    return coarse, fine, membership(spark, d).select("id", F.col("cluster_id").alias("fine_id"))


@query("hier_probe", f"WITH {_INDEX}, up AS (SELECT c.cluster_id, k.cluster_id AS coarse_id, row_number() OVER (PARTITION BY c.cluster_id ORDER BY list_distance(c.centroid, k.centroid), k.cluster_id) AS r FROM centroids c, centroids k WHERE k.cluster_id < 4), near AS (SELECT qid, cluster_id AS coarse_id, row_number() OVER (PARTITION BY qid ORDER BY list_distance(centroid, qvec), cluster_id) AS r FROM q, centroids WHERE cluster_id < 4), cells AS (SELECT near.qid, up.cluster_id FROM near JOIN up USING (coarse_id) JOIN may ON may.qid = near.qid AND may.cluster_id = up.cluster_id WHERE near.r <= 2 AND up.r = 1), hits AS (SELECT qid, id, {_D} AS dist FROM cells JOIN member USING (cluster_id) JOIN corpus USING (id) JOIN q USING (qid) WHERE {_HIT}) {_TOP.format('hits', K)}")
def hier_probe(spark: SparkSession, d: str) -> DataFrame:
    coarse, fine, member = _hier(spark, d)
    grams = gramindex.gram_index(parts(spark, d).join(member, "id"), "fine_id")
    return rounded(search.hier(parts(spark, d), part_queries(spark, d), coarse, fine, member, grams, K, 2))


@query("hier_trained", _FACTS)
def hier_trained(spark: SparkSession, d: str) -> DataFrame:
    rows = parts(spark, d)
    coarse, fine, member = cluster.hierarchical(rows, 4, 4, 10)
    member = written(member, "fine-membership")
    grams = gramindex.gram_index(rows.join(member.select("id", "fine_id"), "id"), "fine_id")
    return _facts(rows, part_queries(spark, d), search.hier(rows, part_queries(spark, d), coarse, fine, member.select("id", "fine_id"), grams, K, 3), 0.6)


_KNN = f"knn AS (SELECT * FROM (SELECT a.build_id, a.id AS src, b.id AS dst, list_distance(a.vec, b.vec) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) AS rank FROM corpus a JOIN corpus b ON a.build_id = b.build_id AND a.id <> b.id) WHERE rank <= 8)"


@query("graph_knn_edges", f"WITH {_ITEMS}, {_KNN} SELECT build_id, src, dst, round(dist, 6) AS dist, rank FROM knn")
def graph_knn_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.knn_edges(items(spark, d), DIM, 8))


_LETTERS = f"g AS (SELECT id, list_distinct({_GRAMS.format('l')}) AS g FROM (SELECT id, coalesce(regexp_replace({_PRE.format('text')}, ' ', '', 'g'), '') AS l FROM items))"


@query("graph_shared_grams", f"WITH {_ITEMS}, {_KNN}, {_LETTERS} SELECT src, dst, len(list_intersect(a.g, b.g))::BIGINT AS shared FROM knn JOIN g a ON a.id = src JOIN g b ON b.id = dst")
def graph_shared_grams(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared_grams(graph.knn_edges(items(spark, d), DIM, 8), items(spark, d))


@query("graph_degree", f"WITH {_ITEMS}, {_KNN}, both_ways AS (SELECT src, dst, dist FROM knn UNION SELECT dst, src, dist FROM knn), cut AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM both_ways) SELECT src, count(*) AS degree FROM cut WHERE r <= 16 GROUP BY src")
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.symmetric(graph.knn_edges(items(spark, d), DIM, 8), 16)
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


@query("graph_exact_search", SQL["ann_full_ef"])
def graph_exact_search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.graph(parts(spark, d), part_queries(spark, d), node_grams(spark, d), K))


@query("graph_beam", _FACTS)
def graph_beam(spark: SparkSession, d: str) -> DataFrame:
    rows = parts(spark, d)
    edges = written(graph.symmetric(graph.knn_edges(rows.withColumn("build_id", F.lit(0)), DIM, 16), 32), "edges")
    return _facts(rows, part_queries(spark, d), search.search("graph_beam", rows, part_queries(spark, d), K, edges=edges, entries=workload.sample(rows, 8), ef=64, rounds=3, node_grams=node_grams(spark, d)), 0.8)


@query("graph_cell_edges", f"WITH {_PARTS} SELECT count(*) AS rows, true AS enough FROM corpus")
def graph_cell_edges(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours looked for in the 8 nearest of 16 cells only: rows with edges, and whether 0.6 of the true ones are
    there; these vectors have no structure that cells could follow."""
    rows = parts(spark, d).withColumn("build_id", F.lit(0))
    near = written(graph.cell_edges(rows, centroids(spark, d), DIM, 8, 8), "cell-edges")
    true_ = graph.knn_edges(rows, DIM, 8).select("src", "dst")
    share = true_.join(near.select("src", "dst"), ["src", "dst"], "left_semi").agg(F.count("*").alias("hit")).join(true_.agg(F.count("*").alias("n")))
    return near.agg(F.count_distinct("src").alias("rows")).join(share).select("rows", (F.col("hit") >= 0.6 * F.col("n")).alias("enough"))


@query("graph_full_search", SQL["ann_full_ef"])
def graph_full_search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.graph_full(parts(spark, d), part_queries(spark, d), K))


@query("grams_overlap", f"WITH {_LETTERS} SELECT a.id, len(a.g) > 0 AND len(b.g) > 0 AND list_has_any(a.g, b.g) AS shares FROM g a, (SELECT g FROM g WHERE id = (SELECT min(id) FROM items WHERE len(text) > 20)) b")
def grams_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d).select("id", F.coalesce(T.trigrams(T.preprocess_letters(F.col("str"))), F.array().cast("array<string>")).alias("g"))
    first = items(spark, d).filter(F.length("str") > 20).agg(F.min_by("str", "id").alias("s")).select(T.trigrams(T.preprocess_letters(F.col("s"))).alias("other"))
    return rows.join(F.broadcast(first)).select("id", T.has_common(F.col("g"), F.col("other")).alias("shares"))


# --- evaluation and workload -------------------------------------------------------------------------------------

_PRED = f"pred AS (SELECT qid, id FROM (SELECT qid, id, str, regex, row_number() OVER (PARTITION BY qid ORDER BY {_D}, id) AS r FROM corpus JOIN q USING (build_id)) WHERE r <= {K * 10} AND {_HIT} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY r) <= {K})"
_RECALL = f"{_ITEMS}, {_ITEM_Q}, {_GT}, gt AS (SELECT qid, id FROM hits QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, id) <= {K}), {_PRED}, per AS (SELECT qid, count(pred.id) AS hits, count(gt.id) AS wanted FROM q LEFT JOIN gt USING (qid) LEFT JOIN pred USING (qid, id) GROUP BY qid), r AS (SELECT qid, hits, wanted, CASE WHEN wanted = 0 THEN 1.0::DOUBLE ELSE hits / wanted END AS recall FROM per)"


@query("recall_at_k", f"WITH {_RECALL} SELECT qid, hits, wanted, round(recall, 6) AS recall FROM r")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    rows, q = items(spark, d), item_queries(spark, d)
    got = evaluate.recall(q, exact.groundtruth(rows, q, K), exact.postfilter(rows, q, K, 10, 10), K)
    return got.withColumn("recall", F.round("recall", 6))


@query("recall_summary", f"WITH {_RECALL} SELECT count(*) AS queries, round(avg(recall), 6) AS mean_recall, round(min(recall), 6) AS min_recall, round(max(recall), 6) AS max_recall, count(*) FILTER (WHERE recall >= 1 - 1e-9) AS perfect FROM r")
def recall_summary(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.summary(recall_at_k(spark, d))
    return s.select("queries", *[F.round(c, 6).alias(c) for c in ("mean_recall", "min_recall", "max_recall")], "perfect")


_WORDS = "w AS (SELECT id, list_transform(list_filter(regexp_extract_all(text, '([A-Za-z]+)', 1), lambda w: len(w) >= 3), lambda w: lower(w)) AS w FROM items WHERE text IS NOT NULL)"
_TWO = "FROM (SELECT id, w[id % greatest(len(w) - 1, 1) + 1] AS a, w[id % greatest(len(w) - 1, 1) + 2] AS b FROM w WHERE len(w) >= 2) WHERE a <> b"
_STYLE_SQL = {
    "substring": "SELECT id, w[id % greatest(len(w), 1) + 1] AS regex FROM w WHERE len(w) >= 1",
    "prefix": "SELECT id, '^' || w[1] AS regex FROM w WHERE len(w) >= 1",
    "suffix": "SELECT id, w[-1] || '$' AS regex FROM w WHERE len(w) >= 1",
    "alternation": f"SELECT id, a || '|' || b AS regex {_TWO}",
    "wildcard": f"SELECT id, a || '.*' || b AS regex {_TWO}",
    "mixed": f"SELECT id, a || '.*' || b || '|' || b || '.*' || a AS regex {_TWO}",
}


def _style(style: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return workload.candidates(items(spark, d), (style,)).select("id", "regex")

    query(f"style_{style}", f"WITH {_WORDS} {_STYLE_SQL[style]}")(run)


for _s in workload.STYLES:
    _style(_s)


@query("query_gen_candidates", f"WITH {_WORDS} " + " UNION ALL ".join(f"SELECT id, '{s}' AS style, regex FROM ({q})" for s, q in _STYLE_SQL.items()))
def query_gen_candidates(spark: SparkSession, d: str) -> DataFrame:
    return workload.candidates(items(spark, d))


@query("selectivity_band", f"WITH m AS ({SQL['regex_match_count']}), n AS (SELECT count(*) AS n FROM items) SELECT qid, matches FROM m, n WHERE matches BETWEEN greatest({K}, ceil(n * 0.01)) AND floor(n * 0.5)")
def selectivity_band(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d)
    q = spark.createDataFrame([(i, p) for i, p in enumerate(PATTERNS)], "qid long, regex string")
    return workload.with_selectivity(q, exact.match_counts(rows, dict(enumerate(PATTERNS))), rows.count(), 0.01, 0.5, K).select("qid", "matches")


_SOURCES = "w AS (SELECT * FROM (SELECT id, list_transform(list_filter(regexp_extract_all(text, '([A-Za-z]+)', 1), lambda w: len(w) >= 3), lambda w: lower(w)) AS w FROM items WHERE text IS NOT NULL AND id % 100 = 0))"
_GENERATED = (
    f"{_ITEMS}, {_SOURCES}, made AS (" + " UNION ALL ".join(f"SELECT id * 10 + {i} AS qid, id, '{n}' AS style, regex FROM ({_STYLE_SQL[n]})" for i, n in enumerate(workload.STYLES)) + "), "
    "counted AS (SELECT qid, count(*) AS matches FROM made JOIN items ON regexp_matches(text, regex, 'i') GROUP BY qid), "
    f"kept AS (SELECT made.*, matches FROM made JOIN counted USING (qid), (SELECT count(*) AS n FROM items) WHERE matches BETWEEN greatest({K}, ceil(n * 0.01)) AND floor(n * 0.5))"
)


def _generated(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d)
    return workload.generate(rows, rows.filter("id % 100 = 0"), 0.01, 0.5, K)


@query("query_gen_accepted", f"WITH {_GENERATED} SELECT qid, id, style, regex, matches FROM kept")
def query_gen_accepted(spark: SparkSession, d: str) -> DataFrame:
    return _generated(spark, d).drop("qvec")


@query("query_gen_truth", f"WITH {_GENERATED}, q AS (SELECT qid, regex, vec AS qvec, build_id FROM kept JOIN corpus USING (id)), {_GT} {_TOP.format('hits', K)}")
def query_gen_truth(spark: SparkSession, d: str) -> DataFrame:
    kept = written(_generated(spark, d).filter(V.usable(F.col("qvec"), DIM)), "workload")
    q = small(kept, 600).join(items(spark, d).select("id", "build_id"), "id")
    return rounded(exact.groundtruth(items(spark, d), q, K))


def _kept(made: str, lo: float, hi: float) -> str:
    return (
        f"{_SOURCES}, made AS ({made}), counted AS (SELECT qid, count(*) AS matches FROM made JOIN items ON regexp_matches(text, regex, 'i') GROUP BY qid) "
        f"SELECT made.*, matches FROM made JOIN counted USING (qid), (SELECT count(*) AS n FROM items) WHERE matches BETWEEN greatest({K}, ceil(n * {lo})) AND floor(n * {hi})"
    )


@query("query_gen_strict", "WITH " + _kept(f"SELECT id * 10 AS qid, id, 'wildcard' AS style, regex FROM ({_STYLE_SQL['wildcard']})", 0.001, 0.2))
def query_gen_strict(spark: SparkSession, d: str) -> DataFrame:
    """One style, none in its place where it gives no pattern; a wide band."""
    rows = items(spark, d)
    return workload.generate(rows, rows.filter("id % 100 = 0"), 0.001, 0.2, K, ("wildcard",)).drop("qvec")


@query("query_gen_cycled", "WITH " + _kept(" UNION ALL ".join(f"SELECT id * 10 + {i} AS qid, id, '{n}' AS style, regex FROM ({_STYLE_SQL[n]}) WHERE id // 100 % 6 = {i}" for i, n in enumerate(workload.STYLES)), 0.01, 0.5))
def query_gen_cycled(spark: SparkSession, d: str) -> DataFrame:
    """Each source takes the next style in turn."""
    rows = items(spark, d)
    turn = F.pmod(F.floor(F.col("id") / 100), F.lit(6))
    return workload.generate(rows, rows.filter("id % 100 = 0"), 0.01, 0.5, K, cycle=turn).drop("qvec")


_CONTAINED = ("vector", "graph", "tree", "hash", "river", "album", "live", "close", "search", "the")


@query("fixed_patterns", "SELECT p.n::BIGINT AS qid, count(*) FILTER (WHERE regexp_matches(text, '.*' || p.w || '.*', 'i')) AS matches FROM items, (VALUES " + ", ".join(f"({i}, '{w}')" for i, w in enumerate(_CONTAINED)) + ") p(n, w) GROUP BY ALL")
def fixed_patterns(spark: SparkSession, d: str) -> DataFrame:
    return exact.match_counts(items(spark, d), dict(enumerate(workload.containing(_CONTAINED))))


@query("recall_external", f"WITH {_RECALL} SELECT qid, hits, wanted, round(hits / {K}, 6) AS recall FROM r")
def recall_external(spark: SparkSession, d: str) -> DataFrame:
    """Recall as the external baseline counts it: hits by k, whatever the size of the ground truth."""
    rows, q = items(spark, d), item_queries(spark, d)
    got = evaluate.recall(q, exact.groundtruth(rows, q, K), exact.postfilter(rows, q, K, 10, 10), K, "k")
    return got.withColumn("recall", F.round("recall", 6))


@query("cluster_set_operations", f"WITH {_INDEX}, a AS (SELECT cluster_id FROM may WHERE qid = (SELECT min(qid) FROM q)), b AS (SELECT cluster_id FROM cg WHERE gram = 'red') SELECT 'both' AS op, cluster_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'any', cluster_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'all', cluster_id FROM centroids")
def cluster_set_operations(spark: SparkSession, d: str) -> DataFrame:
    q = part_queries(spark, d)
    first = q.join(q.agg(F.min("qid").alias("qid")), "qid")
    a = search.candidate_clusters(first, cluster_grams(spark, d), centroids(spark, d)).select("cluster_id")
    b = cluster_grams(spark, d).filter("gram = 'red'").select("cluster_id")
    each = {"both": a.intersect(b), "any": a.union(b).distinct(), "all": centroids(spark, d).select("cluster_id")}
    out = [df.select(F.lit(op).alias("op"), "cluster_id") for op, df in each.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _grid(runs: list[tuple[str, str, object]]) -> str:
    return "SELECT *, true AS sane FROM (VALUES " + ", ".join(f"('parts', '{m}', '{p}', '{v}')" for m, p, v in runs) + ") t(dataset, method, param, param_value)"


def _sane(spark: SparkSession, metrics: DataFrame) -> DataFrame:
    """Runs of a sweep, written as CSV and read again, with a check of what they measured."""
    path = f"{checkpoint_dir(spark)}/summary-{uuid.uuid4().hex}"
    sweep.write_csv(metrics, path)
    got = spark.read.schema(metrics.schema).csv(path, header=True)
    sane = F.col("recall_pct").between(0, 100) & (F.col("min_recall") * 100 <= F.col("recall_pct") + 1e-6) & (F.col("perfect") <= F.col("queries")) & (F.col("avg_time_ms") > 0) & (F.col("qps") > 0)
    exact_ = (F.col("param") != "sample_ratio") | (F.col("param_value") != "1.0") | (F.col("recall_pct") == 100)
    return got.select("dataset", "method", "param", "param_value", (sane & exact_).alias("sane"))


_RUNS = [*(("ann", "ef", ef) for ef in (10, 50)), *(("prefilter", "sample_ratio", r) for r in (1.0, 0.5)), *(("postfilter", "max_expansion", m) for m in (10, 100))]


@query("parameter_sweep", _grid(_RUNS))
def parameter_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows, q = parts(spark, d), written(part_queries(spark, d), "queries")
    truth = written(exact.groundtruth(rows, q, K), "truth")
    how = {"ann": lambda v: _ann(spark, d, v, 8), "prefilter": lambda v: exact.prefilter(rows, q, K, v), "postfilter": lambda v: exact.postfilter(rows, q, K, 10, v)}
    return _sane(spark, sweep.together({"parts": sweep.sweep(q, truth, [(m, p, v, lambda m=m, v=v: how[m](v)) for m, p, v in _RUNS], K)}))


_CLUSTER_RUNS = [("ann", f"clusters={c} ef", ef) for c in (4, 16) for ef in (10, 100)]


@query("sweep_clusters_ef", _grid(_CLUSTER_RUNS))
def sweep_clusters_ef(spark: SparkSession, d: str) -> DataFrame:
    rows, q = parts(spark, d), written(part_queries(spark, d), "queries")
    return _sane(spark, sweep.together({"parts": sweep.clusters_by_ef(rows, q, written(codebook(spark, d), "codebook"), (4, 16), (10, 100), K)}))


_CLASSES = ("substring", "prefix", "wildcard")


@query("sweep_pattern_class_ef", _grid([("ann", f"class={c} ef", ef) for c in _CLASSES for ef in (10, 100)]))
def sweep_pattern_class_ef(spark: SparkSession, d: str) -> DataFrame:
    rows = parts(spark, d)
    c, book = centroids(spark, d), written(codebook(spark, d), "codebook")
    made = workload.candidates(rows.filter("id % 100 = 0"), _CLASSES).join(rows.select("id", F.col("vec").alias("qvec")), "id").select(F.col("id").alias("qid"), "style", "regex", "qvec")
    return _sane(spark, sweep.together({"parts": sweep.classes_by_ef(rows, written(made, "classes"), c, book, (10, 100), K)}))


_FILES = "SELECT '{0}' AS fmt, id, i::INT AS pos, round(v[i + 1]::DOUBLE, 6) + 0.0 AS x FROM (SELECT row_number() OVER (ORDER BY {1}) - 1 AS id, {2} AS v FROM {3}), range({4}) t(i)"
_NODES_OK = f"(SELECT id, vec FROM nodes WHERE {_OK.format('vec', 32)})"


@query("vector_files", " UNION ALL ".join(_FILES.format(f, *x) for f, x in (("fvecs", ("vec_id", "embedding", "embeddings", DIM)), ("fbin", ("vec_id", "embedding", "embeddings", DIM)), ("bvecs", ("id", "vec", _NODES_OK, 32)), ("ivecs", ("id", "vec", _NODES_OK, 32)))))
def vector_files(spark: SparkSession, d: str) -> DataFrame:
    """Written as vector files in parts and read again; ids are positions."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    n = table(spark, d, "nodes").filter(V.usable(F.col("vec"), 32)).select("id", "vec")
    out = []
    for fmt, df in (("fvecs", e), ("fbin", e), ("bvecs", n), ("ivecs", n)):
        path = f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
        binary.write_vectors(df, path, fmt)
        got = binary.read_vectors(spark, path, fmt)
        out.append(got.select(F.lit(fmt).alias("fmt"), "id", F.posexplode(F.col("vec").cast("array<double>")).alias("pos", "x")).withColumn("x", F.round("x", 6) + 0.0))
    return reduce(DataFrame.unionByName, out)


@query("string_lines", r"SELECT row_number() OVER (ORDER BY id) - 1 AS id, regexp_replace(text, '[\r\n]+', ' ', 'g') AS str FROM items WHERE text IS NOT NULL")
def string_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts as a file of lines, one a row, read again; ids are line numbers. The form is one file."""
    path = f"{checkpoint_dir(spark)}/strings-{uuid.uuid4().hex}"
    lines = table(spark, d, "items").filter("text is not null").select("id", F.regexp_replace("text", r"[\r\n]+", " ").alias("value"))
    lines.orderBy("id").select("value").coalesce(1).write.text(path)
    return textio.load_strings(spark, path)


@query("first_rows", "SELECT id, text AS str FROM items ORDER BY id LIMIT 50")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).orderBy("id").limit(50).select("id", "str")


@query("query_text_tabs", f"WITH {_ITEMS}, {_ITEM_Q} SELECT qid, regex, i::INT AS pos, round(printf('%.6f', qvec[i + 1])::FLOAT::DOUBLE, 6) AS x FROM q, range({DIM}) t(i)")
def query_text_tabs(spark: SparkSession, d: str) -> DataFrame:
    """The form with a tab, in which patterns may hold blanks."""
    lines = textio.format_queries(item_queries(spark, d), "\t")
    back = textio.parse_queries(lines.withColumnRenamed("qid", "id"))
    return back.select("qid", "regex", F.posexplode("qvec").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


@query("query_text_codec", f"WITH {_ITEMS}, {_ITEM_Q} SELECT qid, regex, i::INT AS pos, round(printf('%.6f', qvec[i + 1])::FLOAT::DOUBLE, 6) AS x FROM (SELECT * FROM q WHERE regex NOT LIKE '% %'), range({DIM}) t(i)")
def query_text_codec(spark: SparkSession, d: str) -> DataFrame:
    lines = textio.format_queries(item_queries(spark, d).filter(~F.col("regex").contains(" ")))
    back = textio.parse_queries(lines.withColumnRenamed("qid", "id"))
    return back.select("qid", "regex", F.posexplode("qvec").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


@query("result_text_codec", SQL["groundtruth_batch"].replace(", round(dist, 6) AS dist", ""))
def result_text_codec(spark: SparkSession, d: str) -> DataFrame:
    q = item_queries(spark, d)
    lines = textio.format_results(q, exact.groundtruth(items(spark, d), q, K))
    return textio.parse_results(lines.withColumnRenamed("qid", "id"))


@query("reservoir_sample", "SELECT id FROM items ORDER BY md5('42-' || id), id LIMIT 100")
def reservoir_sample(spark: SparkSession, d: str) -> DataFrame:
    return workload.sample(items(spark, d), 100).select("id")


# --- heavy keys --------------------------------------------------------------------------------------------------

#: table, key, least share of the rows with a key
HEAVY = (("gram_index", "gram", 1 / 200), ("gram_index", "cluster_id", 1 / 50), ("membership", "cluster_id", 1 / 50))


def _heavy_sql(out: str, heavy: bool) -> str:
    parts_ = []
    for t, k, share in HEAVY:
        parts_.append(
            f"SELECT '{t}' AS table_name, '{k}' AS key_name, build_id, key_value, {out} FROM (SELECT build_id, key_value, sum(n)::BIGINT AS rows, count(*) AS ids, max_by(id, (n, -id)) AS top_id, max(n) AS top_rows FROM "
            f"(SELECT build_id, {k}::VARCHAR AS key_value, id, count(*) AS n FROM {t} WHERE {k} IS NOT NULL GROUP BY ALL) GROUP BY ALL) "
            + (f"JOIN (SELECT build_id, count({k}) AS total FROM {t} GROUP BY build_id) USING (build_id) WHERE rows * {round(1 / share)} >= total" if heavy else "")
        )
    return " UNION ALL ".join(parts_)


def _keys(t: str) -> dict[str, int]:
    return {k: round(1 / share) for name, k, share in HEAVY if name == t}


@query("p4_found", _heavy_sql("top_id", True))
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    each = []
    for t in dict.fromkeys(t for t, _, _ in HEAVY):
        got = heavykeys.heavy(table(spark, d, t), ["build_id"], _keys(t), "id")
        each.append(got.select(F.lit(t).alias("table_name"), "key_name", "build_id", "key_value", "top_id"))
    return each[0].unionByName(each[1])


@query("p4_per_key", _heavy_sql("rows, ids, top_id, top_rows", False))
def p4_per_key(spark: SparkSession, d: str) -> DataFrame:
    each = []
    for t in dict.fromkeys(t for t, _, _ in HEAVY):
        got = heavykeys.per_key(heavykeys.keyed(table(spark, d, t), ["build_id"], list(_keys(t)), "id"), ["build_id"])
        each.append(got.select(F.lit(t).alias("table_name"), "key_name", "build_id", "key_value", "rows", "ids", "top_id", "top_rows"))
    return each[0].unionByName(each[1])
