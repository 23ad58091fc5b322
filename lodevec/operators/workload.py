"""Query workloads from a corpus: patterns in six styles, their selectivity, and samples of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.functions import text as T
from lodevec.operators.exact import match_counts

STYLES = ("substring", "prefix", "suffix", "alternation", "wildcard", "mixed")


def style_regex(style: str, words: Column, pick: Column) -> Column:
    """Pattern of a style from the words of a text; pick is a non-negative number that selects words. Null where the
    text has too few (different) words for the style."""
    n = F.size(words)
    first = F.get(words, F.pmod(pick, F.greatest(n, F.lit(1))).cast("int"))
    i = F.pmod(pick, F.greatest(n - 1, F.lit(1))).cast("int")
    a, b = F.get(words, i), F.get(words, i + 1)
    two = (n >= 2) & (a != b)
    return {
        "substring": F.when(n >= 1, first),
        "prefix": F.when(n >= 1, F.concat(F.lit("^"), F.get(words, F.lit(0)))),
        "suffix": F.when(n >= 1, F.concat(F.element_at(words, -1), F.lit("$"))),
        "alternation": F.when(two, F.concat(a, F.lit("|"), b)),
        "wildcard": F.when(two, F.concat(a, F.lit(".*"), b)),
        "mixed": F.when(two, F.concat(a, F.lit(".*"), b, F.lit("|"), b, F.lit(".*"), a)),
    }[style]


def candidates(rows: DataFrame, styles: tuple[str, ...] = STYLES) -> DataFrame:
    """(id, style, regex): every style a row's text can give; word choice follows the id."""
    words = rows.select("id", T.extract_words(F.col("str")).alias("w")).filter("w is not null")
    each = F.array(*[F.struct(F.lit(s).alias("style"), style_regex(s, F.col("w"), F.col("id")).alias("regex")) for s in styles])
    return words.select("id", F.inline(each)).filter("regex is not null")


def with_selectivity(queries: DataFrame, counts: DataFrame, total: int, lo: float, hi: float, k: int = 10) -> DataFrame:
    """Queries (qid, ...) whose number of matches lies in [max(k, ceil(total * lo)), floor(total * hi)].
    counts: (qid, matches)."""
    least, most = max(k, -int(-total * lo // 1)), int(total * hi)
    if least > most:
        raise ValueError(f"no match count can lie between {least} and {most}")
    return queries.join(counts, "qid").filter(F.col("matches").between(least, most))


def generate(rows: DataFrame, sources: DataFrame, lo: float, hi: float, k: int = 10, styles: tuple[str, ...] = STYLES, cycle: Column | None = None) -> DataFrame:
    """(qid, id, style, regex, matches, qvec): queries from the texts of the source rows (id, str, vec), in every style
    a text can give, kept where the pattern's matches among all rows lie in the band. qvec is the source's own vector.
    qid is 10 * id + number of the style. cycle: the number of the one style a source takes, so that styles come in turn;
    a source whose style gives no pattern in the band gives none."""
    number = F.array_position(F.array(*map(F.lit, styles)), F.col("style")) - 1
    made = candidates(sources, styles).withColumn("qid", F.col("id") * 10 + number)
    made = made if cycle is None else made.filter(number == cycle)
    patterns = {r.qid: r.regex for r in made.select("qid", "regex").collect()}  # the stated query set
    kept = with_selectivity(made, match_counts(rows, patterns), rows.count(), lo, hi, k)
    return kept.join(sources.select("id", F.col("vec").alias("qvec")), "id").select("qid", "id", "style", "regex", "matches", "qvec")


def containing(words: tuple[str, ...]) -> list[str]:
    """The plain list form: a pattern a word, anything before and behind it."""
    return [f".*{w}.*" for w in words]


def sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, all) rows, the first by a seeded hash of the id; the same rows in every run."""
    return rows.orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col("id"))), "id").limit(n)


def distinct_first(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, first): distinct values with their first place by order; null is a value too."""
    return rows.groupBy(value).agg(F.min(order).alias("first"))
