"""Fuzzy label resolution: tiers of containment, restricted to rows that hold data.

Containment joins go over an index of n-grams: a string can only lie in another if its first
trigram (or all of it, if shorter) does, so candidates come from an equi join and are then tested
with contains(). No cross join of queries and labels is made, and queries are resolved once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import leaf, significant_words, strip

GRAM = 3
# Words that do not name a subject, words that stand for one, names of total rows.
STOP_WORDS = (
    "dan", "di", "ke", "dari", "untuk", "yang", "pada", "atau", "dalam", "dengan", "oleh", "atas", "total", "jumlah",
    "posisi", "indonesia", "bank", "penghimpunan", "penyaluran", "pertumbuhan", "perkembangan", "tercatat",
    "the", "of", "a", "an", "and", "in", "for",
)
SYNONYMS = {"dpk": ("simpanan", "dana", "pihak", "ketiga")}
TOTAL_NAMES = ("total", "jumlah")


def grams(c: Column) -> Column:
    """All distinct substrings of 1 to GRAM characters, and the empty string."""
    def of(n: int) -> Column:
        return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array(F.lit("")), *[of(n) for n in range(1, GRAM + 1)]))


def first_gram(c: Column) -> Column:
    return F.substring(c, 1, GRAM)


def match_tiers(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """(q, label, tier, k1, k2) for queries (q) and labels (label), each distinct: the best tier of a pair.

    1 equal but for case and outer blanks; 2 the label contains the query (shorter labels first); 3 the
    query contains the leaf of a qualified label (more shared significant words, then longer leaves first);
    4 the query contains the label (longer first). An empty query lies in every label.
    """
    q = queries.select("q", strip(F.lower("q")).alias("ql"))
    lab = labels.select("label", F.lower("label").alias("ll"), strip(F.lower("label")).alias("ls"), leaf(F.col("label")).alias("lf"))
    whole = q.select("q", "ql", first_gram(F.col("ql")).alias("g")).join(lab.select("label", "ll", F.explode(grams(F.col("ll"))).alias("g")), "g")
    two = whole.where(F.contains("ll", F.col("ql"))).select("q", "label", F.struct(F.lit(2).alias("tier"), F.length("label").alias("k1"), F.lit(0).alias("k2")).alias("m"))
    # What may lie in a query: the label itself, and the leaf of a qualified one.
    needles = F.array(F.struct(F.lit(4).alias("tier"), F.col("ls").alias("n")), F.struct(F.lit(3).alias("tier"), F.nullif("lf", F.lit("")).alias("n")))
    parts = lab.select("label", "ls", F.inline(needles)).where("n IS NOT NULL").withColumn("g", first_gram(F.col("n")))
    inside = q.select("q", "ql", F.explode(grams(F.col("ql"))).alias("g")).join(parts, "g").where(F.contains("ql", F.col("n")))
    shared = F.size(F.array_intersect(significant_words(F.col("label")), significant_words(F.col("ql"))))
    by_leaf = F.struct(F.lit(3).alias("tier"), (-shared).alias("k1"), (-F.length("n")).alias("k2"))
    by_label = F.struct(F.when(F.col("ls") == F.col("ql"), 1).otherwise(4).alias("tier"), F.when(F.col("ls") == F.col("ql"), 0).otherwise(-F.length("label")).alias("k1"), F.lit(0).alias("k2"))
    rest = inside.select("q", "label", F.when(F.col("tier") == 3, by_leaf).otherwise(by_label).alias("m"))
    return two.unionByName(rest).groupBy("q", "label").agg(F.min("m").alias("m")).select("q", "label", "m.*")


def scoped(df: DataFrame) -> DataFrame:
    """df with its scope column: facts only meet tables of their scope (a document or request); 0 if it has none."""
    return df if "scope" in df.columns else df.withColumn("scope", F.lit(0).cast("long"))


def _subject_words(c: Column) -> Column:
    return F.filter(significant_words(c), lambda w: ~w.isin(*STOP_WORDS))


def subject_matches(queries: DataFrame, meta: DataFrame) -> DataFrame:
    """(scope, q, source_ord) where every significant word of the query, or a synonym of it, is in the table's title."""
    synonyms = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    cover = lambda w: F.coalesce(F.array_append(F.try_element_at(synonyms, w), w), F.array(w))
    words = _subject_words(F.replace(F.lower("q"), F.lit("dana pihak ketiga"), F.lit("dpk")))
    q = queries.select("scope", "q", words.alias("qw")).where(F.size("qw") > 0).withColumn("w", F.explode(cover(F.element_at("qw", 1))))
    titles = meta.select("scope", "source_ord", _subject_words(F.col("title")).alias("tw")).withColumn("w", F.explode("tw"))
    both = q.join(titles, ["scope", "w"]).where(F.forall("qw", lambda w: F.arrays_overlap(F.col("tw"), cover(w))))
    return both.select("scope", "q", "source_ord").distinct()


def _exact_first() -> Column:
    """Order of a match: an equal label before all tiers."""
    return F.when(F.col("q") == F.col("label"), F.struct(F.lit(0).alias("tier"), F.lit(0).alias("k1"), F.lit(0).alias("k2"))).otherwise(F.struct("tier", "k1", "k2"))


#: Order of a match by way of the table's subject: behind all tiers.
_LAST = (("tier", 5), ("k1", 0), ("k2", 0))


def _last() -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in _LAST])


def resolve_temporal(queries: DataFrame, meta: DataFrame, data: DataFrame) -> DataFrame:
    """(scope, q, year, month, source_ord) -> matched_label, value, for queries (scope, q, year, month).

    An exact label with data at the month comes first, then the tiers over labels with data there,
    then the first total row with data if the query names the table's subject. Ties: label order.
    """
    queries, meta, data = scoped(queries), scoped(meta), scoped(data)
    asked = queries.select("scope", "q", "year", "month").distinct()
    cells = data.where("year IS NOT NULL").select("scope", "source_ord", "row_ord", F.col("row_label").alias("label"), "year", "month", "value")
    tiers = match_tiers(asked.select("q").distinct(), cells.select("label").distinct())
    direct = asked.join(tiers, "q").join(cells, ["scope", "label", "year", "month"]).withColumn("m", _exact_first())
    totals = cells.where(strip(F.lower("label")).isin(*TOTAL_NAMES))
    subject = subject_matches(asked.select("scope", "q").distinct(), meta)
    fallback = asked.join(subject, ["scope", "q"]).join(totals, ["scope", "source_ord", "year", "month"]).withColumn("m", _last())
    keys = ("scope", "q", "year", "month", "source_ord")
    cols = (*keys, "row_ord", "label", "value", "m")
    return (
        direct.select(*cols).unionByName(fallback.select(*cols)).groupBy(*keys)
        .agg(F.min_by(F.struct("label", "value"), F.struct("m", "row_ord")).alias("b"))
        .select(*keys, F.col("b.label").alias("matched_label"), F.col("b.value").alias("value"))
    )


def resolve_categorical(queries: DataFrame, data: DataFrame) -> DataFrame:
    """(scope, q, cq, source_ord) -> matched_label, matched_col, value, for row and column queries (scope, q, cq).

    Rows by tier, and for a row its columns by tier among those that hold data; an exact pair comes first.
    """
    queries, data = scoped(queries), scoped(data)
    asked = queries.select("scope", "q", "cq").distinct()
    cells = data.where("col_label IS NOT NULL").select("scope", "source_ord", "row_ord", F.col("row_label").alias("label"), "col_ord", F.col("col_label").alias("col"), "value")
    names = asked.select("q").distinct().unionByName(asked.select(F.col("cq").alias("q"))).distinct()
    labels = cells.select("label").distinct().unionByName(cells.select(F.col("col").alias("label"))).distinct()
    tiers = match_tiers(names, labels)
    rows = tiers.select("q", "label", F.struct("tier", "k1", "k2").alias("rm"))
    columns = tiers.select(F.col("q").alias("cq"), F.col("label").alias("col"), F.struct("tier", "k1", "k2").alias("cm"))
    found = asked.join(rows, "q").join(cells, ["scope", "label"]).join(columns, ["cq", "col"])
    order = F.struct(~((F.col("q") == F.col("label")) & (F.col("cq") == F.col("col"))), "rm", "row_ord", "cm", "col_ord")
    keys = ("scope", "q", "cq", "source_ord")
    return found.groupBy(*keys).agg(F.min_by(F.struct("label", "col", "value"), order).alias("b")).select(
        *keys, F.col("b.label").alias("matched_label"), F.col("b.col").alias("matched_col"), F.col("b.value").alias("value")
    )


def resolve_label(queries: DataFrame, meta: DataFrame, rows: DataFrame) -> DataFrame:
    """(scope, q, source_ord) -> matched_label without looking at data: exact, tiers, then the total row."""
    queries, meta, rows = scoped(queries), scoped(meta), scoped(rows)
    asked = queries.select("scope", "q").distinct()
    labels = rows.select("scope", "source_ord", "row_ord", F.col("row_label").alias("label"))
    tiers = match_tiers(asked.select("q").distinct(), labels.select("label").distinct())
    direct = asked.join(tiers, "q").join(labels, ["scope", "label"]).withColumn("m", _exact_first())
    totals = labels.where(strip(F.lower("label")).isin(*TOTAL_NAMES))
    fallback = subject_matches(asked, meta).join(totals, ["scope", "source_ord"]).withColumn("m", _last())
    cols = ("scope", "q", "source_ord", "row_ord", "label", "m")
    return direct.select(*cols).unionByName(fallback.select(*cols)).groupBy("scope", "q", "source_ord").agg(F.min_by("label", F.struct("m", "row_ord")).alias("matched_label"))


def available_periods(queries: DataFrame, meta: DataFrame, rows: DataFrame, data: DataFrame) -> DataFrame:
    """(scope, q, source_ord, year, month): months with data for the label that a query resolves to; none on a categorical axis."""
    found = resolve_label(queries, meta, rows)
    temporal = scoped(data).where("year IS NOT NULL").select("scope", "source_ord", F.col("row_label").alias("matched_label"), "year", "month").distinct()
    return found.join(temporal, ["scope", "source_ord", "matched_label"]).select("scope", "q", "source_ord", "year", "month")
