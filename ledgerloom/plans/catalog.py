"""Views of a dataset: hot and sealed tables, labels, children, and authored SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import BIG_KINDS, IMPLICIT, empty_table, with_big_columns
from ledgerloom.plans.guard import parse, split_statements
from ledgerloom.sources.store import MOST_HOT_ROWS

MOST_HOPS = 8


def labels_view(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(address, label) of label files (JSON arrays), lower-cased; snapshots may overlap."""
    return spark.read.schema("address string, label string").option("multiLine", True).json(paths).select(F.lower("address").alias("address"), "label").distinct()


def table_names(columns: dict[str, str], timestamps: bool = True) -> tuple[list[str], list[str]]:
    """(all columns, big ones) of a declared table."""
    implicit = [c for c in IMPLICIT if timestamps or c != "block_timestamp"]
    return sorted({*columns, *implicit}), [c for c, kind in columns.items() if kind in BIG_KINDS]


def dataset_views(store, schema: dict[str, dict[str, str]], timestamps: bool = True, without: frozenset = frozenset()) -> dict[str, DataFrame]:
    """Every declared, sealed or hot table as one view; one that never had a row is empty, not absent. Callers' queries run on these, so a tip beyond the bound is refused."""
    state = store.state()
    out = {}
    for table in sorted({*schema, *state.tables, *state.hot}):
        names, big = table_names(schema.get(table, {}), timestamps)
        if table not in schema:
            found = [store.spark.read.parquet(f"{store.shared}/{s.file}").columns for s in store.segments(table, state=state)]
            found += [store.spark.read.parquet(f"{store.root}/{f}").columns for f in state.hot.get(table, [])]
            names = sorted({*names, *(c for cs in found for c in cs if c != "table")})
        out[table] = store.view(table, names, big, MOST_HOT_ROWS, without) if table in state.tables or table in state.hot else empty_table(store.spark, names, big)
    return out


@dataclass
class ViewReport:
    built: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    missing: dict[str, list[str]] = field(default_factory=dict)
    root_of: dict[str, str] = field(default_factory=dict)


def _created(statement: str) -> tuple[str, str] | None:
    """(name, body) of CREATE VIEW name AS body."""
    import re

    m = re.match(r"(?is)create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?view\s+[\"`]?([A-Za-z0-9_]+)[\"`]?\s+as\s+(.*)$", statement.strip())
    return (m[1], m[2]) if m else None


def authored_views(spark: SparkSession, tables: dict[str, DataFrame], files: dict[str, str]) -> tuple[dict[str, DataFrame], ViewReport]:
    """Views from SQL files in the order of their names. A statement that fails doesn't stop the others; the
    report says why, which tables it lacks, and which earlier view is the root of it."""
    report, views, lacks = ViewReport(), {}, {}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    for file in sorted(files):
        for statement in split_statements(files[file]):
            made = _created(statement)
            if not made:
                report.failed[f"{file}: {statement[:40]}"] = "only CREATE VIEW ... AS SELECT is allowed"
                continue
            view, body = made
            known = {*tables, *views}
            try:
                parsed = parse(spark, body)
                absent = sorted(r for r in parsed.relations if r.lower() not in {k.lower() for k in known})
                if absent:
                    lacks[view] = absent
                    report.missing[view] = absent
                    raise ValueError(f"no table {', '.join(absent)}")
                df = spark.sql(body)
                df.createOrReplaceTempView(view)
                views[view] = df
                report.built.append(view)
            except (ValueError, AnalysisException, ParseException) as e:
                report.failed[view] = str(e)
    for view in lacks:
        at, hops = view, 0
        while hops < MOST_HOPS and (nxt := next((a for a in lacks.get(at, []) if a in report.failed), None)):
            at, hops = nxt, hops + 1
        report.root_of[view] = at
    return views, report


def base_tables(spark: SparkSession, sql: str, bodies: dict[str, str]) -> set[str]:
    """Tables behind a query, through at most eight views."""
    names, seen = parse(spark, sql).relations, set()
    for _ in range(MOST_HOPS):
        views = {n for n in names if n in bodies and n not in seen}
        if not views:
            break
        seen |= views
        names = (names - views) | {r for v in views for r in parse(spark, bodies[v]).relations}
    return names


def children_view(tables: dict[str, tuple[DataFrame, str]], timestamps: bool = True) -> DataFrame:
    """The first discovery of each child over several (rows, child column)."""
    from ledgerloom.operators.folds import earliest_children

    out = None
    for df, child in tables.values():
        part = df.withColumn("child", F.col(f"`{child}`")).select("child", "block_number", "log_index", "address", *(["block_timestamp"] * timestamps))
        out = part if out is None else out.unionByName(part)
    return earliest_children(out, timestamps)


def with_companions(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return with_big_columns(df, [c for c, kind in columns.items() if kind in BIG_KINDS])
