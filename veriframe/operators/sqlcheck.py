"""Checking of claims by guarded SQL over catalog tables: hints, execution, sufficiency, retry, judging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that make a claim a comparison.
COMPARISON = (
    "tertinggi", "terendah", "paling tinggi", "paling rendah", "paling besar", "paling kecil", "lebih tinggi", "lebih rendah",
    "lebih besar", "lebih kecil", "naik dari", "turun dari", "meningkat dari", "menurun dari", "dibandingkan", "dibanding",
    "ketimbang", "tren", "trend",
)
MAX_DISTINCT = 30
#: Rows that a query's result may have; a claim needs a handful.
RESULT_ROWS = 1000


def is_comparison(claim: Column) -> Column:
    low = F.lower(claim)
    return F.exists(F.array(*map(F.lit, COMPARISON)), lambda k: F.contains(low, k))


def insufficient(rows: Column) -> Column:
    """Whether a result (array of arrays of text) cannot support a comparison: none, all null, or one row with one value."""
    values = F.filter(F.flatten(rows), lambda v: v.isNotNull())
    return (F.size(rows) == 0) | (F.size(values) == 0) | ((F.size(rows) == 1) & (F.size(values) < 2))


def distinct_value_hints(table: DataFrame, name: str, max_distinct: int = MAX_DISTINCT) -> DataFrame:
    """(table_name, columns, vals): the values of each text column with at most max_distinct of them, then
    the tuples that occur together if two columns or more have so few and the tuples are at most twice as many.
    """
    spark = table.sparkSession
    texts = [c for c, t in table.dtypes if t == "string"]
    empty = spark.createDataFrame([], "table_name string, columns array<string>, vals array<array<string>>")
    if not texts:
        return empty
    # A set is collected only for columns whose approximate count is small; the exact test follows.
    rough = table.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(texts)]).first()
    few = [c for i, c in enumerate(texts) if rough[i] and rough[i] <= 2 * max_distinct]
    if not few:
        return empty
    counts = table.agg(*[F.count_distinct(c).alias(f"n{i}") for i, c in enumerate(few)]).first()
    good = [c for i, c in enumerate(few) if 0 < counts[i] <= max_distinct]
    out = empty
    for c in good:
        vals = table.select(c).distinct().agg(F.array_sort(F.collect_list(F.array(c))).alias("vals"))
        out = out.unionByName(vals.select(F.lit(name).alias("table_name"), F.array(F.lit(c)).alias("columns"), "vals"))
    if len(good) > 1:
        tuples = table.select(*good).distinct().limit(2 * max_distinct + 1).agg(F.array_sort(F.collect_list(F.array(*good))).alias("vals"))
        out = out.unionByName(tuples.where((F.size("vals") > 0) & (F.size("vals") <= 2 * max_distinct)).select(F.lit(name).alias("table_name"), F.array(*map(F.lit, good)).alias("columns"), "vals"))
    return out


#: Parts of a parsed query that are allowed; whatever is not named here is refused.
NODES = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except", "Intersect", "SubqueryAlias", "OneRowRelation",
    "UnresolvedRelation", "UnresolvedWith", "UnresolvedInlineTable", "LocalRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedHaving", "WithWindowDefinition", "LateralJoin", "Pivot", "Unpivot",
}
#: Functions that call code by name or tell about files and the session.
REFUSED = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user", "user", "version", "current_database", "current_schema", "current_catalog"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def check_query(spark: SparkSession, sql: str) -> None:
    """Raise ValueError unless sql is one plain query over listed tables by built-in functions.

    The parsed plan is walked with its expressions, subqueries and named parts. Only NODES are allowed, so commands,
    scripts, table functions and transformations are not; a relation must be a listed table, a view or a part of the query itself.
    """
    session = spark._jsparkSession.sessionState()
    plan = session.sqlParser().parsePlan(sql)
    listed = {t.name.lower() for t in spark.catalog.listTables()}
    functions = session.functionRegistry()
    named, read, stack = set(), set(), [plan]
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName()
        if _is_plan(spark, node):
            if kind not in NODES:
                raise ValueError(f"{kind} is not allowed in a query")
            if kind == "SubqueryAlias":
                named.add(node.alias().lower())
            if kind == "UnresolvedWith":
                for part in _items(node.cteRelations()):
                    named.add(part._1().lower())
                    stack.append(part._2())
            if kind == "UnresolvedRelation":
                read.add(".".join(_items(node.multipartIdentifier())).lower())
            stack += _items(node.expressions())
        else:
            if kind == "UnresolvedFunction":
                names = [n.lower() for n in _items(node.nameParts())]
                if len(names) != 1 or names[0] in REFUSED or not functions.functionExists(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(names[0])):
                    raise ValueError(f"the function {'.'.join(names)} is not allowed in a query")
            if spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression").isInstance(node):
                stack.append(node.plan())
        stack += _items(node.children())
    if unknown := read - listed - named:
        raise ValueError(f"no such table: {', '.join(sorted(unknown))}")


def _is_plan(spark: SparkSession, node) -> bool:
    return spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan").isInstance(node)


def execute(spark: SparkSession, sql: str) -> tuple[list[list[str | None]] | None, str | None]:
    """(rows as text, None) or (None, error). A result of more than RESULT_ROWS rows is an error, never a part of it."""
    try:
        check_query(spark, sql)
        rows = spark.sql(sql).limit(RESULT_ROWS + 1).collect()
        if len(rows) > RESULT_ROWS:
            raise ValueError(f"the result has more than {RESULT_ROWS} rows; aggregate it")
        return [[None if v is None else str(v) for v in r] for r in rows], None
    except Exception as e:
        return None, str(e).split("\n")[0][:500]


Generator = Callable[[list[tuple[int, str, str | None]]], list[tuple[int, str]]]
Judge = Callable[[list[tuple[int, str, str, list]]], list[tuple[int, str, str]]]
RUN = "claim_ord int, claim string, sql_query string, result array<array<string>>, error string"
RESULT = "claim_ord int, claim string, status string, reasoning string, sql_query string"
SHORT = "the result cannot support a comparison"


def run_claims(spark: SparkSession, claims: list[str], generate: Generator) -> DataFrame:
    """Claims with query and result (RUN). One call makes all queries, one more those of failed claims.

    A query that fails, or gives too little for a comparison, is asked for again once, with the error.
    Indices that were not asked for are ignored. Claims and results of one document are few, so this loop is the driver's.
    """
    runs: dict[int, list] = {i: [c, None, None, "no query was generated"] for i, c in enumerate(claims)}

    def attempt(asked: list[tuple[int, str, str | None]]) -> None:
        wanted = {i for i, _, _ in asked}
        for i, sql in generate(asked):
            if i in wanted:
                rows, error = execute(spark, sql)
                if error is None and any(k in claims[i].lower() for k in COMPARISON):
                    values = [v for r in rows for v in r if v is not None]
                    if not values or (len(rows) == 1 and len(values) < 2):
                        error = SHORT
                runs[i][1:] = [sql, rows, error]

    if claims:
        attempt([(i, c, None) for i, c in enumerate(claims)])
        failed = [(i, c, runs[i][3]) for i, c in enumerate(claims) if runs[i][3]]
        if failed:
            attempt(failed)
    return spark.createDataFrame([(i, *r) for i, r in runs.items()], RUN)


def judge_claims(runs: DataFrame, judge: Judge) -> DataFrame:
    """One row a claim (RESULT): Error without a query for SQL errors, Error with it where no verdict came."""
    spark = runs.sparkSession
    good = [(r["claim_ord"], r["claim"], r["sql_query"], r["result"]) for r in runs.where("error IS NULL").orderBy("claim_ord").collect()]
    told = spark.createDataFrame(judge(good) if good else [], "claim_ord int, status string, reasoning string").dropDuplicates(["claim_ord"])
    failed = F.col("error").isNotNull()
    return runs.join(told, "claim_ord", "left").select(
        "claim_ord", "claim", F.when(failed, "Error").otherwise(F.coalesce("status", F.lit("Error"))).alias("status"),
        F.when(failed, F.col("error")).otherwise(F.coalesce("reasoning", F.lit("no verdict"))).alias("reasoning"), F.when(~failed, F.col("sql_query")).alias("sql_query"),
    ).orderBy("claim_ord")


def verify_document(spark: SparkSession, text: str, extract: Callable[[str], list[str]], generate: Generator, judge: Judge) -> DataFrame:
    """Claims of a text through SQL to verdicts; a text without claims touches no table."""
    claims = [c.strip() for c in extract(text) if c and c.strip()]
    return judge_claims(run_claims(spark, claims, generate), judge) if claims else spark.createDataFrame([], RESULT)


def verify_claim(spark: SparkSession, claim: str, generate: Generator, judge: Judge) -> DataFrame:
    """The result (RESULT) of one claim; a blank one gives no row."""
    return verify_document(spark, claim, lambda text: [text], generate, judge)


def summary(results: DataFrame) -> DataFrame:
    """One row: number of claims by status, and the sentence."""
    n = results.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Entailed", "Refuted", "Inconclusive", "Error")])
    return n.withColumn("summary", F.format_string("%d claims: %d entailed, %d refuted, %d inconclusive, %d errors", "total", "entailed", "refuted", "inconclusive", "error"))


def list_tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name,) for t in spark.catalog.listTables()], "name string").orderBy("name")


def browse(table: DataFrame, key: str, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of a table in the order of key; limit is held between 1 and 1000."""
    return table.orderBy(key).offset(max(0, offset)).limit(min(max(1, limit), 1000))


def browse_with_total(table: DataFrame, key: str, limit: int = 200, offset: int = 0) -> tuple[DataFrame, int]:
    """A page of a table and the number of its rows."""
    return browse(table, key, limit, offset), table.count()
