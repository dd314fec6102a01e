"""A read-only SQL surface: what a query may name is decided on its parsed plan, and refused unless known to be safe."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

MOST_TEXT = 16 << 10
MOST_ROWS = 50_000
DEADLINE_S = 30.0
CONCURRENT = 2
#: Functions that reach out of the data: JVM calls, files, settings of the session, state of the machine.
DENIED = frozenset(
    """java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length
    current_user session_user user current_catalog current_database current_schema version spark_partition_id
    read_files read_kafka raise_error assert_true java_udf hive_udf from_avro to_avro schema_of_avro""".split()
)
#: Functions that make rows and may stand in FROM.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack".split())
_NAME = re.compile(r"[A-Za-z0-9_]+")


class Refused(ValueError):
    """The guard's reason."""


def strip_comments(sql: str) -> str:
    """``sql`` with comments as blanks; quoted text is left alone."""
    out, i, n = [], 0, len(sql)
    while i < n:
        two = sql[i : i + 2]
        if two == "--":
            end = sql.find("\n", i)
            i = n if end < 0 else end
            out.append(" ")
        elif two == "/*":
            depth, i = 1, i + 2
            while i < n and depth:
                step = sql[i : i + 2]
                depth += (step == "/*") - (step == "*/")
                i += 2 if step in ("/*", "*/") else 1
            out.append(" ")
        elif sql[i] in "'\"`":
            quote, start = sql[i], i
            i += 1
            while i < n:
                if sql[i] == "\\" and quote != "`":
                    i += 2
                elif sql[i] == quote:
                    i += 1
                    if i < n and sql[i] == quote:
                        i += 1
                    else:
                        break
                else:
                    i += 1
            out.append(sql[start:i])
        else:
            out.append(sql[i])
            i += 1
    return "".join(out)


def split_statements(sql: str) -> list[str]:
    """Statements between semicolons that aren't quoted; comments are dropped."""
    text, out, start, i = strip_comments(sql), [], 0, 0
    while i < len(text):
        if text[i] in "'\"`":
            quote = text[i]
            i += 1
            while i < len(text) and text[i] != quote:
                i += 2 if text[i] == "\\" and quote != "`" else 1
        elif text[i] == ";":
            out.append(text[start:i])
            start = i + 1
        i += 1
    return [s.strip() for s in [*out, text[start:]] if s.strip()]


@dataclass
class Parsed:
    """What a query names."""

    sql: str
    relations: set[str] = field(default_factory=set)
    functions: set[str] = field(default_factory=set)
    plan: object = None


def _seq(seq) -> list:
    """A sequence of the JVM as a list."""
    it, out = seq.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def _children(node) -> list:
    """Subplans of a node: its children, common table expressions and subqueries in expressions."""
    return _seq(node.children()) + _seq(node.innerChildren())


def _walk(node, parsed: Parsed, ctes: set[str]) -> None:
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedRelation":
        parts = list(_seq(node.multipartIdentifier()))
        if len(parts) != 1 or not _NAME.fullmatch(parts[0]):
            raise Refused(f"only tables of this dataset can be read, not {'.'.join(parts)}")
        if parts[0].lower() not in ctes:
            parsed.relations.add(parts[0])
    elif kind == "UnresolvedTableValuedFunction":
        name = ".".join(_seq(node.name())).lower()
        if name not in TABLE_FUNCTIONS:
            raise Refused(f"table function {name} isn't allowed")
    elif kind == "UnresolvedWith":
        for pair in _seq(node.cteRelations()):
            _walk(pair._2(), parsed, ctes)
            ctes = ctes | {pair._1().lower()}
    for e in _seq(node.expressions()):
        _walk_expression(e, parsed, ctes)
    for child in _children(node):
        if hasattr(child, "expressions"):
            _walk(child, parsed, ctes)
        else:
            _walk_expression(child, parsed, ctes)


def _walk_expression(e, parsed: Parsed, ctes: set[str]) -> None:
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        name = ".".join(_seq(e.nameParts())).lower()
        parsed.functions.add(name)
        if name in DENIED or "." in name:
            raise Refused(f"function {name} isn't allowed")
    for child in _seq(e.children()):
        _walk_expression(child, parsed, ctes)
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression", "UnresolvedTableArgPlanId"):
        if kind == "InSubquery":
            _walk_expression(e.query(), parsed, ctes)
        elif hasattr(e, "plan"):
            _walk(e.plan(), parsed, ctes)


def parse(spark: SparkSession, sql: str) -> Parsed:
    """The query's plan, if it is one read-only statement that names nothing it mustn't."""
    if len(sql.encode()) > MOST_TEXT:
        raise Refused("the query is too long")
    statements = split_statements(sql)
    if len(statements) != 1:
        raise Refused("exactly one statement is allowed")
    text = statements[0]
    if not re.match(r"(?i)\(*\s*(select|with|values|from)\b", text):
        raise Refused("only SELECT and WITH are allowed")
    # ASOF JOIN would run as a plain join with "asof" taken for an alias.
    if re.search(r"(?i)\basof\s+(left\s+)?join\b", re.sub(r"'(?:[^'\\]|\\.)*'", "''", text)):
        raise Refused("ASOF JOIN isn't SQL that this engine knows; use the as_of operator")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    parsed = Parsed(text, plan=plan)
    name = plan.getClass().getName()
    if ".command." in name or "Command" in plan.getClass().getSimpleName() or plan.getClass().getSimpleName().startswith(("Insert", "Create", "Drop", "Replace", "Set", "Alter", "Cache", "Refresh", "Show", "Describe", "Explain", "Delete", "Update", "Merge", "Load")):
        raise Refused("only SELECT and WITH are allowed")
    _walk(plan, parsed, set())
    return parsed


@dataclass
class Answer:
    """A result with what is known about its completeness."""

    rows: list
    columns: list[str]
    truncated: bool = False
    degraded_tables: list[str] = field(default_factory=list)
    as_of: int | None = None
    sealed_through: int | None = None


class Surface:
    """Guarded SQL over the tables of a dataset. ``tables`` are views that the session knows by these names."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, authored: dict[str, str] | None = None, most_rows: int = MOST_ROWS, deadline_s: float = DEADLINE_S):
        self.spark, self.most_rows, self.deadline_s = spark, most_rows, deadline_s
        self.tables: dict[str, DataFrame] = {}
        self.authored = authored or {}
        self.slots = threading.BoundedSemaphore(CONCURRENT)
        for name, df in (tables or {}).items():
            self.add(name, df)

    def add(self, name: str, df: DataFrame) -> None:
        if not _NAME.fullmatch(name):
            raise Refused(f"not a table name: {name}")
        df.createOrReplaceTempView(name)
        self.tables[name] = df

    def frame(self, sql: str, args: dict | None = None) -> DataFrame:
        """The query as a DataFrame; nothing has run."""
        from ledgerloom.plans.errors import hint, text_sum_of_big

        parsed = parse(self.spark, sql)
        known = {t.lower() for t in self.tables} | {v.lower() for v in self.authored}
        unknown = sorted(r for r in parsed.relations if r.lower() not in known)
        if unknown:
            raise Refused(hint(f"table {unknown[0]}", self.tables, unknown_table=unknown[0]))
        try:
            df = self.spark.sql(parsed.sql, args=args) if args else self.spark.sql(parsed.sql)
        except (AnalysisException, ParseException) as e:
            raise Refused(hint(e, self.tables)) from e
        if complaint := text_sum_of_big(df):
            raise Refused(complaint)
        return df

    def explain(self, sql: str) -> dict:
        """Whether a query binds, with a hint where it doesn't. Only analysed: no job runs."""
        try:
            df = self.frame(sql)
        except (Refused, ParseException) as e:
            return {"valid": False, "error": scrub(str(e))}
        return {"valid": True, "columns": [[f.name, f.dataType.simpleString()] for f in df.schema]}

    def run(self, sql: str, args: dict | None = None) -> Answer:
        """Rows up to the cap. One time limit holds for all of it; a full house refuses at once."""
        if not self.slots.acquire(blocking=False):
            raise Refused("too many queries at once")
        tag, expired, ended = f"ledgerloom-{uuid.uuid4().hex}", threading.Event(), threading.Event()
        sc = self.spark.sparkContext
        late = TimeoutError(f"the query took longer than {self.deadline_s} s")

        def watch() -> None:
            # A job may start after the limit, when planning took it all, so interrupts go on until the call ends.
            # The tag is the context's: a session knows its own tags only in the thread that added them.
            wait = self.deadline_s
            while not ended.wait(wait):
                expired.set()
                sc.cancelJobsWithTag(tag)
                wait = 0.1

        watcher = threading.Thread(target=watch, name=tag, daemon=True)
        watcher.start()
        sc.addJobTag(tag)
        sc.setInterruptOnCancel(True)
        try:
            from ledgerloom.operators.reads import capped

            df = self.frame(sql, args)
            if expired.is_set():
                raise late
            found = capped(df, self.most_rows)
            if expired.is_set():
                raise late
            return Answer(found.rows, df.columns, found.truncated)
        except Exception as e:
            if expired.is_set() and e is not late:
                raise late from e
            raise
        finally:
            ended.set()
            watcher.join()
            sc.removeJobTag(tag)
            sc.setInterruptOnCancel(False)
            self.slots.release()


def scrub(message: str) -> str:
    """An error message without paths."""
    return re.sub(r"(?:[a-z][a-z0-9+.-]*:)?/(?:[\w.@%+=~-]+/)*[\w.@%+=~-]*", "<path>", message)
