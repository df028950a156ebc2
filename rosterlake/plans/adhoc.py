"""Read-only ad-hoc SQL: audit of query texts, row cap and guarded execution."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions.rules import stripped
from rosterlake.plans import routing
from rosterlake.sources.tables import LAYERS, Tables

# Words a query text must not contain, in checking order.
FORBIDDEN = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE",
    "CREATE", "GRANT", "REVOKE", "EXEC", "CALL", "INTO OUTFILE",
)
MULTI = "Multi-statement queries (containing semicolons) are prohibited."
START = "Query must strictly begin with SELECT or WITH."
VALID = "Valid"
ROW_CAP = 100

# Tables known under a second name.
VIEW_ALIASES = {"fact_performance_reviews": ("Fact_PerformanceReviews",)}
# Parts of a parsed query that may run: reading, combining and shaping rows. Anything else, such
# as a script, a command or a table function, is refused.
_PLAN_NODES = frozenset(
    "Project Filter Aggregate Join Sort Window WithWindowDefinition Distinct Union Intersect Except "
    "GlobalLimit LocalLimit Offset SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith "
    "UnresolvedHaving UnresolvedRelation UnresolvedInlineTable OneRowRelation LocalRelation "
    "LateralJoin Pivot Unpivot UnresolvedOrdinal".split()
)
# Functions that compute on their arguments alone.
_FUNCTIONS = frozenset(
    "abs add_months any any_value approx_count_distinct array avg bool_and bool_or bround cast ceil ceiling char_length "
    "coalesce collect_list collect_set concat concat_ws corr count count_if cume_dist current_date current_timestamp "
    "date date_add date_diff date_format date_sub date_trunc datediff day dayname dayofmonth dayofweek dayofyear "
    "dense_rank every exp extract first first_value floor format_number greatest hour if ifnull initcap instr "
    "isnotnull isnull lag last last_day last_value lcase lead least left length like ln locate log lower lpad ltrim "
    "make_date max max_by mean median min min_by mod mode month monthname months_between now nth_value ntile nullif "
    "nvl nvl2 percent_rank percentile percentile_approx pmod position pow power quarter rank regexp_extract "
    "regexp_replace replace reverse right round row_number rpad rtrim sign some split sqrt std stddev stddev_pop "
    "stddev_samp string struct substr substring sum to_date to_number to_timestamp trim trunc try_cast try_divide "
    "typeof ucase upper var_pop var_samp variance weekofyear width_bucket year".split()
)


def normal_text(sql_text: Column) -> Column:
    """The text as the rules judge it."""
    return F.upper(stripped(sql_text))


def audit_reason(text: Column) -> Column:
    """'Valid' or the message of the first rule a normal text breaks. Text is judged as text:
    a forbidden word inside a literal counts."""
    all_but_last = F.substring(text, F.lit(1), F.greatest(F.length(text) - 1, F.lit(0)))
    reason = F.when(all_but_last.contains(";"), MULTI).when(
        ~(text.startswith("SELECT") | text.startswith("WITH")), START
    )
    # One pattern clears the valid texts; the words are told apart only after a hit.
    reason = reason.when(~text.rlike(rf"(?U)\b({'|'.join(FORBIDDEN)})\b"), VALID)
    for word in FORBIDDEN:
        reason = reason.when(
            text.rlike(rf"(?U)\b{word}\b"), f"Forbidden keyword detected: '{word}'."
        )
    return reason.otherwise(VALID)


def has_limit(sql_text: Column) -> Column:
    """Whether a row limit is written anywhere in the text, in a subquery too."""
    return sql_text.rlike(r"(?iU)\bLIMIT\s+\d+")


def capped_sql(sql_text: Column, cap: int = ROW_CAP) -> Column:
    """The text with a row limit, unless it has one."""
    bare = F.regexp_replace(sql_text, r";+\z", "")
    limited = F.concat(bare, F.lit(f" LIMIT {cap};"))
    return F.when(has_limit(sql_text), sql_text).otherwise(limited)


def sql_audit(queries: DataFrame, column: str = "sql_text") -> DataFrame:
    """Verdict per query text; only valid ones get a text to run."""
    audited = (
        queries.withColumn("__text", normal_text(F.col(column)))
        .withColumn("reason", audit_reason(F.col("__text")))
        .drop("__text")
        .withColumn("valid", F.col("reason") == VALID)
    )
    return audited.withColumn("limited_sql", F.when(F.col("valid"), capped_sql(F.col(column))))


class RejectedQuery(ValueError):
    """The query text may not be run."""


def _listed(seq) -> list:
    return [seq.apply(n) for n in range(seq.size())]


def _plan_parts(plan):
    """All nodes of a parsed plan, those of its subqueries and named queries among them."""
    yield plan
    below = _listed(plan.children()) + _listed(plan.subqueries())
    if plan.nodeName() == "UnresolvedWith":
        below += _listed(plan.innerChildren())
    for part in below:
        yield from _plan_parts(part)


def _function_names(expression):
    if expression.nodeName() in ("UnresolvedFunction", "UnresolvedGenerator"):
        parts = expression.nameParts() if expression.nodeName() == "UnresolvedFunction" else None
        yield ".".join(_listed(parts)) if parts is not None else expression.name().toString()
    for child in _listed(expression.children()):
        yield from _function_names(child)


def _parsed(session: SparkSession, sql_text: str) -> list:
    """All parts of the text's plan. Nothing is run or looked up."""
    try:
        plan = session._jsparkSession.sessionState().sqlParser().parsePlan(sql_text)
    except Py4JJavaError as error:
        kind = error.java_exception.getClass().getSimpleName()
        raise RejectedQuery(f"Query contains text that is no query ({kind}), which is not allowed.") from error
    except (ParseException, AnalysisException) as error:
        kind = error.getCondition()
        raise RejectedQuery(f"Query contains text that is no query ({kind}), which is not allowed.") from error
    return list(_plan_parts(plan))


def _own_names(parts: list) -> set[str]:
    """The queries that the text names itself."""
    return {
        alias.alias().lower()
        for part in parts
        if part.nodeName() == "UnresolvedWith"
        for alias in _listed(part.innerChildren())
    }


def _field_names(expression):
    if expression.nodeName() == "UnresolvedAttribute":
        yield _listed(expression.nameParts())[-1]
    for child in _listed(expression.children()):
        yield from _field_names(child)


def route(session: SparkSession, sql_text: str) -> tuple[str, str]:
    """(layer, reason) of one query, from the fields and tables of its parsed plan."""
    parts = _parsed(session, sql_text.strip().rstrip(";"))
    fields = {f for part in parts for e in _listed(part.expressions()) for f in _field_names(e)}
    relations = [_listed(p.multipartIdentifier())[-1].lower() for p in parts if p.nodeName() == "UnresolvedRelation"]
    return routing.layer_of(fields, set(relations) - _own_names(parts))


def refused_part(parts: list, views: set[str]) -> str | None:
    """What in a parsed text is no plain query over the given views, or None."""
    named = _own_names(parts)
    for part in parts:
        if part.nodeName() not in _PLAN_NODES:
            return part.nodeName()
        if part.nodeName() == "UnresolvedRelation":
            name = _listed(part.multipartIdentifier())
            if len(name) != 1 or name[0].lower() not in views | named:
                return f"table {'.'.join(name)}"
        for expression in _listed(part.expressions()):
            for function in _function_names(expression):
                if function.lower() not in _FUNCTIONS:
                    return f"function {function}"
    return None


def run_guarded(
    store: Tables, sql_text: str, layer: str | None = None, cap: int = ROW_CAP
) -> DataFrame:
    """Run one audited query against the current tables of one layer.

    Without a limit of its own it returns at most ``cap`` rows. The layer follows from the fields
    that the text needs, unless it is given; anything given that is not the star schema means the
    operational layer. The text is parsed before anything runs: only the layer's views, the text's
    own named queries and listed functions may occur.
    """
    text = store.spark.range(1).select(F.lit(sql_text).alias("sql_text"))
    verdict = text.select(
        audit_reason(normal_text(F.col("sql_text"))).alias("reason"),
        has_limit(F.col("sql_text")).alias("limited"),
    ).first()
    if verdict["reason"] != VALID:
        raise RejectedQuery(verdict["reason"])
    session = store.spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    bare = sql_text.strip().rstrip(";")
    parts = _parsed(session, bare)
    if layer is None:
        layer, _ = route(session, bare)
    names = LAYERS[routing.STAR if layer.upper() == routing.STAR else routing.OPERATIONAL]
    tables = Tables(session, store.root).tables(names)
    views = {view: t for name, t in tables.items() for view in (name, *VIEW_ALIASES.get(name, ()))}
    refused = refused_part(parts, {view.lower() for view in views})
    if refused:
        raise RejectedQuery(f"Query contains {refused}, which is not allowed.")
    for view, table in views.items():
        table.createOrReplaceTempView(view)
    result = session.sql(bare)
    return result if verdict["limited"] else result.limit(cap)
