"""What callers of a dataset can ask for, as methods that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.operators import folds, reads, screening
from ledgerloom.plans import catalog, semantic
from ledgerloom.plans.guard import Answer, Refused, Surface, parse
from ledgerloom.sources.store import Store


class Dataset:
    """A store with its declared schema (table -> column -> storage kind), labels and authored views.

    Views follow the store: they are made anew when its state has another version.
    """

    def __init__(self, store: Store, schema: dict[str, dict[str, str]], labels: DataFrame | None = None, authored: dict[str, str] | None = None, described: dict[str, dict] | None = None, timestamps: bool = True, **limits):
        self.store, self.declared, self.labels, self.authored = store, schema, labels, authored or {}
        self.described, self.timestamps, self.limits = described or {}, timestamps, limits
        self._version: tuple | None = None
        self._surface: Surface | None = None

    def surface(self, without: frozenset = frozenset()) -> Surface:
        version = (self.store.state().version, without)
        if self._surface is None or version != self._version:
            tables = catalog.dataset_views(self.store, self.declared, self.timestamps, without)
            if self.labels is not None:
                tables["labels"] = self.labels
            made = Surface(self.store.spark, tables, **self.limits)
            views, self.report = catalog.authored_views(self.store.spark, tables, self.authored)
            for name, df in views.items():
                made.add(name, df)
            self._surface, self._version = made, version
        return self._surface

    # -- what there is

    def tables(self) -> list[str]:
        return sorted(self.surface().tables)

    def schema(self) -> dict[str, dict]:
        """Tables with descriptions, kinds and what to beware of."""
        return semantic.describe(self.declared, self.described)[0]

    # -- rows

    def table(self, name: str, limit: int = 100, from_block: int | None = None, to_block: int | None = None) -> DataFrame:
        """The newest rows of a table."""
        df = self._of(name)
        return reads.recent_rows(df, df.limit(0), limit, from_block, to_block)

    def entity(self, text: str) -> DataFrame:
        return reads.entity(self._events(), text)

    def entities(self, limit: int = 100) -> DataFrame:
        return reads.recent_entities(self._events(), limit)

    def _of(self, name: str) -> DataFrame:
        found = self.surface().tables
        if name not in found:
            raise Refused(f"there is no table {name}")
        return found[name]

    def _events(self) -> dict[str, DataFrame]:
        return {t: df for t, df in self.surface().tables.items() if {"block_number", "log_index"} <= set(df.columns)}

    # -- SQL

    def explain(self, sql: str) -> dict:
        return self.surface().explain(sql)

    def sql(self, sql: str, args: dict | None = None) -> Answer:
        """An answer with its provenance. If it fails for damaged segments of the tables it names, these are left out,
        it runs once more, and the tables are named as degraded."""
        state = self.store.state()
        try:
            answer = self.surface().run(sql, args)
        except (Refused, TimeoutError):
            raise
        except Exception:
            named = catalog.base_tables(self.store.spark, sql, self._bodies())
            bad = self.store.damaged(sorted(named))
            if not bad:
                raise
            answer = self.surface(frozenset(s.hash for _, s, _ in bad)).run(sql, args)
            answer.degraded_tables = sorted({t for t, _, _ in bad})
            self._version = None
        answer.as_of, answer.sealed_through = state.cursor, state.sealed_through
        return answer

    def _bodies(self) -> dict[str, str]:
        from ledgerloom.plans.guard import split_statements

        made = [catalog._created(s) for text in self.authored.values() for s in split_statements(text)]
        return {name: body for name, body in filter(None, made)}

    def named_tables(self, sql: str) -> set[str]:
        """Tables that a query names, views included."""
        return parse(self.store.spark, sql).relations

    # -- derived

    def balances(self, table: str) -> DataFrame:
        return folds.net_balances(self._of(table))

    def balance(self, table: str, address: str) -> DataFrame:
        return folds.balance_of(self.balances(table), address)

    def top_balances(self, table: str, n: int = 10) -> DataFrame:
        return folds.top_balances(self.balances(table), n)

    def exposure(self, table: str, address: str) -> DataFrame:
        if self.labels is None:
            raise Refused("the dataset has no labels")
        return folds.exposure_of(folds.exposure(self._of(table), self.labels), address)

    def flags(self, table: str, kind: str, threshold: int, width: int = folds.BUCKET_BLOCKS) -> DataFrame:
        """``velocity`` or ``threshold`` flags."""
        if kind == "velocity":
            return folds.velocity_flags(folds.velocity(self._of(table), width), threshold)
        if kind == "threshold":
            return folds.threshold_flags(self._of(table), threshold, table)
        raise Refused(f"unknown kind of flag: {kind}")

    def screen(self, table: str, listed: DataFrame) -> DataFrame:
        return screening.screen(self._of(table), listed)
