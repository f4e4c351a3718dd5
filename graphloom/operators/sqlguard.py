"""Reading SQL safely: what a text may be is decided on its parsed plan, and where it runs on a session of its own.

A text is parsed, and the plan is walked as objects: every node and expression
must be of a class that is listed here, every function a built-in one of a listed
group, every relation a table that was given or a name that the query itself
defines around it.  What isn't listed is refused: commands, scripts
(``TRANSFORM``), files, calls of JVM methods, names made at run time.

Each logical database has a session of its own, in which its tables are views.
Queries bind no names when they run, so threads can't see each other's tables.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JNetworkError
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

PLANS = frozenset(
    """Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LimitAll LocalLimit LocalRelation Offset OneRowRelation PipeOperator Pivot Project
    RepartitionByExpression Sample Sort SubqueryAlias Tail Union Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith WithWindowDefinition""".split()
)
EXPRESSIONS = frozenset(
    """Add AggregateExpression Alias And AnyValue AttributeReference BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Coalesce Collate Concat CreateNamedStruct Cube
    CurrentRow$ Divide EqualNullSafe EqualTo Exists First GreaterThan GreaterThanOrEqual GroupingSets ILike In InSubquery IntegralDivide IsNotNull IsNull LambdaFunction Last
    LateralSubquery LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal Lower MultiAlias Multiply NamedArgumentExpression NamedParameter Not NotLikeAll NotLikeAny Or
    Overlay PipeExpression PosParameter RLike Remainder Rollup ScalarSubquery SemiStructuredExtract SortOrder SpecifiedWindowFrame StringLocate StringTrim StringTrimBoth
    StringTrimLeft StringTrimRight Substring Subtract TimestampAdd TimestampDiff UnaryMinus UnaryPositive UnboundedFollowing$ UnboundedPreceding$ UnresolvedAlias
    UnresolvedAttribute UnresolvedCollation UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedRegex UnresolvedStar
    UnresolvedStarExceptOrReplace UnresolvedWindowExpression UnspecifiedFrame$ WindowExpression WindowSpecDefinition""".split()
)
#: Groups of built-in functions that read nothing but their arguments.
GROUPS = frozenset(
    """agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs
    map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs""".split()
)
#: Functions beyond those groups, functions in FROM, and hints.
FUNCTIONS = frozenset(("monotonically_increasing_id", "typeof", "uuid"))
TABLE_FUNCTIONS = frozenset("explode explode_outer inline inline_outer posexplode posexplode_outer range stack".split())
HINTS = frozenset("coalesce merge mergejoin rebalance repartition repartition_by_range shuffle_hash shuffle_merge".split())
_CATALYST = "org.apache.spark.sql.catalyst."


class Refused(ValueError):
    """The statement isn't a query, or more than a query may be."""


@dataclass(frozen=True)
class Part:
    """A node, expression or other structured value of a parsed plan."""

    kind: str  # plan, expression or other
    name: str
    fields: tuple

    def parts(self) -> Iterator[Part]:
        """This one and all below it."""
        yield self
        for x in _below(self.fields):
            yield from x.parts()


def _below(value) -> Iterator[Part]:
    for x in value:
        if isinstance(x, Part):
            yield x
        elif isinstance(x, tuple):
            yield from _below(x)


class _Walker:
    """Turns the JVM's objects of a plan into parts; classes are looked at once."""

    kinds: dict[str, str] = {}

    def __init__(self, spark: SparkSession):
        named = spark._jvm.java.lang.Class.forName
        self.classes = {
            "plan": named(_CATALYST + "plans.logical.LogicalPlan"), "expression": named(_CATALYST + "expressions.Expression"), "other": named(_CATALYST + "trees.TreeNode"),
            "type": named("org.apache.spark.sql.types.DataType"), "many": named("scala.collection.Iterable"), "option": named("scala.Option"), "product": named("scala.Product"),
        }

    def part(self, value):
        if not isinstance(value, JavaObject):
            return value
        name = value.getClass().getName()
        kind = self.kinds.get(name)
        if kind is None:
            kind = self.kinds[name] = next((k for k, c in self.classes.items() if c.isInstance(value)), "leaf")
        if kind in ("leaf", "type"):
            return value
        if kind in ("many", "option"):
            each, out = value.iterator(), []
            while each.hasNext():
                out.append(self.part(each.next()))
            return tuple(out)
        short = name.rsplit(".", 1)[-1]
        if kind == "product":
            return Part("other", short, self.fields(value))
        if not name.startswith(_CATALYST):
            short = name
        # the rows of VALUES are values already
        return Part(kind, short, () if short == "LocalRelation" else self.fields(value))

    def fields(self, value) -> tuple:
        return tuple(self.part(value.productElement(i)) for i in range(value.productArity()))


def parsed(spark: SparkSession, text: str) -> Part:
    """The plan of a text; raises ParseException for text that isn't SQL."""
    if "${" in text:
        raise Refused("variables aren't replaced in queries")
    return _Walker(spark).part(spark._jsparkSession.sessionState().sqlParser().parsePlan(text))


def _function(spark: SparkSession, name: tuple[str, ...], more: frozenset[str] = FUNCTIONS) -> None:
    """Refuses what isn't a built-in function of a listed group."""
    if len(name) == 1 and name[0].lower() in more:
        return
    found = None
    if len(name) == 1:
        key = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name[0].lower())
        found = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(key)
    if found is None or found.isEmpty() or found.get().getSource() != "built-in" or found.get().getGroup() not in GROUPS:
        raise Refused(f"the function {'.'.join(name)} can't be called")


def _allowed(spark: SparkSession, part: Part, tables: frozenset[str] | None) -> None:
    """Refuses what isn't listed in the part and below it; ``tables`` are the names that can be read here (None: any table by name)."""
    if part.kind != "other" and part.name not in (PLANS if part.kind == "plan" else EXPRESSIONS):
        raise Refused(f"only queries are allowed, not {part.name}")
    if part.kind == "other" and part.name not in ("Tuple2", "Tuple3", "UsingJoin", "NaturalJoin") and any(x.kind == "plan" for x in _below(part.fields)):
        raise Refused(f"only queries are allowed, not {part.name}")
    if part.name == "UnresolvedRelation":
        names, options, streaming = part.fields
        known = all(re.fullmatch(r"\w+", n) for n in names) if tables is None else len(names) == 1 and names[0].lower() in tables
        if not known or streaming or not options.isEmpty():
            raise Refused(f"unknown relation {'.'.join(names)}")
    elif part.name == "UnresolvedFunction":
        _function(spark, part.fields[0])
    elif part.name == "UnresolvedGenerator":
        _function(spark, tuple(x for field_ in reversed(part.fields[0].fields) for x in (field_ if isinstance(field_, tuple) else (field_,))))
    elif part.name == "UnresolvedTableValuedFunction":
        if len(part.fields[0]) != 1 or part.fields[0][0].lower() not in TABLE_FUNCTIONS:
            raise Refused(f"the function {'.'.join(part.fields[0])} can't be read from")
    elif part.name == "UnresolvedHint" and part.fields[0].lower() not in HINTS:
        raise Refused(f"the hint {part.fields[0]} can't be given")
    if part.name == "UnresolvedWith":
        child, relations, recursive = part.fields
        for relation in relations:
            name, plan = relation.fields[0].lower(), relation.fields[1]
            _allowed(spark, plan, tables if tables is None else tables | {name} if recursive else tables)
            # a name can be read after it is defined, and inside this query only
            tables = tables if tables is None else tables | {name}
        _allowed(spark, child, tables)
        return
    for x in _below(part.fields):
        _allowed(spark, x, tables)


def require_query(spark: SparkSession, text: str, tables: Iterable[str] | None = None) -> Part:
    """The parsed plan of a query; refuses everything else, and relations other than ``tables`` if they are given."""
    plan = parsed(spark, text)
    _allowed(spark, plan, None if tables is None else frozenset(t.lower() for t in tables))
    return plan


def _in_session(spark: SparkSession, plan) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def private_session(spark: SparkSession, tables: dict[str, DataFrame]) -> SparkSession:
    """A session with the settings of ``spark``, whose only views are the tables; files can't be read by name in it."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    own.conf.set("spark.sql.variable.substitute", "false")
    for name, df in tables.items():
        _in_session(own, df._jdf.logicalPlan()).createOrReplaceTempView(name)
    return own


def run_in(own: SparkSession, spark: SparkSession, tables: Iterable[str], text: str, args: dict | None = None) -> DataFrame:
    """The rows of a query in a private session, as a table of ``spark``."""
    require_query(own, text, tables)
    return _in_session(spark, own.sql(text, args=args or {})._jdf.queryExecution().analyzed())


def run_on(spark: SparkSession, tables: dict[str, DataFrame], text: str, args: dict | None = None) -> DataFrame:
    """The rows of a query that sees these tables only."""
    return run_in(private_session(spark, tables), spark, tables, text, args)


def joins(spark: SparkSession, text: str) -> list[set[str]]:
    """For each join of the query, the columns that its condition names: last parts, in lower case."""
    out = []
    for part in parsed(spark, text).parts():
        if part.name in ("Join", "LateralJoin"):
            condition = part.fields[2:]
            named = [x.fields[0] for c in _below(condition) for x in c.parts() if x.name == "UnresolvedAttribute"]
            using = [(c,) for x in _below(condition) if x.name == "UsingJoin" for c in x.fields[1]]
            out.append({names[-1].lower() for names in [*named, *using] if names})
    return out


def _joins_or_none(spark: SparkSession, text: str) -> list[set[str]] | None:
    try:
        return joins(spark, text)
    except (ParseException, Refused):
        return None


@dataclass
class Tracker:
    """What a session has run: queries, and the join column that was recommended."""

    queries: list[tuple[str, str]] = field(default_factory=list)
    keys_asked: bool = False
    join_column: str | None = None

    def check(self, spark: SparkSession, database: str, text: str) -> dict | None:
        """An error if the query breaks the protocol; else None, and the query counts as run.

        A second query without a join after a first one without is refused; so
        is a join on a name, one before join keys were asked for, and one that
        doesn't use the recommended column.
        """
        # text that can't be parsed fails when it is run; as a first query it says nothing of those after it
        conditions = _joins_or_none(spark, text) or []
        first_joins = _joins_or_none(spark, self.queries[0][1]) if self.queries else None
        if first_joins is not None and not first_joins and not conditions:
            return {"error": "sequential query", "instruction": "ask for join keys and send one query that joins the tables"}
        used = set().union(*conditions)
        if conditions and used & {"name", "fullname", "employeename", "username"}:
            return {"error": "join on name", "recommended_column": self.join_column}
        if conditions and not self.keys_asked:
            return {"error": "join keys were not asked for"}
        if conditions and self.join_column and self.join_column.lower() not in used:
            return {"error": "wrong join column", "recommended_column": self.join_column}
        self.queries.append((database, text))
        return None


def rows_in_time(df: DataFrame, seconds: float = 25.0) -> list[dict]:
    """The rows of a short result; its jobs are cancelled if they take longer."""
    sc, group = df.sparkSession.sparkContext, f"guard-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "guarded query", interruptOnCancel=True)
    timer.start()
    try:
        return [r.asDict(recursive=True) for r in df.collect()]
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the query took longer than {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def renewed(run: Callable[[], list[dict]], renew: Callable[[], None]) -> list[dict]:
    """The run's result; if the connection is lost it is renewed, and the run made once more."""
    try:
        return run()
    except (ConnectionError, EOFError, Py4JNetworkError):
        renew()
        return run()


class Databases:
    """Logical databases: each has named tables and a session of its own, and queries see the tables of one."""

    def __init__(self, spark: SparkSession, databases: dict[str, dict[str, DataFrame]]):
        self.spark, self.databases = spark, databases
        self._sessions: dict[str, tuple[dict[str, DataFrame], SparkSession]] = {}
        self._lock = threading.Lock()

    def _session(self, database: str) -> SparkSession:
        """The database's session; made at its first query, and again when its tables are others."""
        tables = dict(self.databases[database])
        with self._lock:
            known, own = self._sessions.get(database, (None, None))
            if known is None or known.keys() != tables.keys() or any(known[k] is not tables[k] for k in tables):
                own = private_session(self.spark, tables)
                self._sessions[database] = tables, own
            return own

    def execute(self, database: str, text: str, limit: int | None = 100, args: dict | None = None) -> DataFrame:
        """The query's rows, ``limit`` at most; raises KeyError for an unknown database and Refused for what isn't a query."""
        if database not in self.databases:
            raise KeyError(f"unknown database {database}; there are {', '.join(sorted(self.databases))}")
        out = run_in(self._session(database), self.spark, self.databases[database], text, args)
        return out if limit is None else out.limit(limit)

    def execute_query(self, database: str, text: str, limit: int = 100) -> dict:
        """As a result dict: columns, row_count, data and whether rows were cut off, or an error."""
        try:
            df = self.execute(database, text, limit + 1)
            rows = [r.asDict(recursive=True) for r in df.collect()]
        except Exception as e:  # the caller gets every failure as a result
            return {"error": str(e).splitlines()[0], "database": database, "query": text}
        return {"database": database, "columns": df.columns, "row_count": len(rows[:limit]), "data": rows[:limit], "truncated": len(rows) > limit, "query": text}

    def sample(self, database: str, name: str, columns: list[str] | None = None, limit: int = 10) -> DataFrame:
        df = self.databases[database][name]
        return df.select(*(columns or df.columns)).limit(limit)
