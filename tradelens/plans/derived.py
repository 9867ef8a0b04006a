"""Derived tables that build on each other (P02, P53), kept up to date.

The original script is a chain of CREATE TABLE AS statements. Here every derived table and
every report is a node with named inputs: roles, or other nodes. A node's
fingerprint is made of its definition and its inputs' fingerprints; a role's of
its rows. :meth:`DerivedTables.refresh` builds, in order, the nodes whose
fingerprint differs from that of their stored version and what they need, and leaves the others as they are:
a join that several reports share is made once, and a changed input rebuilds
its dependants only. Nodes are stored as versioned tables, so a lost driver leaves every
one of them at a whole version and the next run goes on from there.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.operators import audits, sales
from tradelens.plans.catalog import REPORTS
from tradelens.sources.roles import SCHEMAS, Roles
from tradelens.sources.versioned import VersionedTable


def row_fingerprint(df: DataFrame) -> str:
    """Of a table's columns and rows, in any order and partitioning: their number, the sum
    and the parity of their hashes. One scan, one row of partial aggregates a task."""
    own = df.select(*[F.col(f"`{c}`") for c in df.columns])
    h = F.xxhash64(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in df.columns])
    row = own.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(h, F.lit(1)))).first()
    return _digest(df.schema.json(), *map(str, row))


def _digest(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


@dataclass(frozen=True)
class Node:
    """``build`` takes the inputs by name. A changed definition is a new ``version`` or
    other code of ``build``."""

    name: str
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    version: str = "1"

    def definition(self) -> str:
        try:
            code = inspect.getsource(self.build)
        except (OSError, TypeError):
            code = getattr(self.build, "__qualname__", "")
        return _digest(self.name, self.version, code, *self.inputs)


class DerivedTables:
    def __init__(self, spark: SparkSession, folder: str, nodes: Iterable[Node]):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.nodes = {n.name: n for n in nodes}
        self._order(list(self.nodes))  # no cycles

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.folder}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.table(name).read()

    def _order(self, names: Iterable[str]) -> list[str]:
        """The nodes that ``names`` need, inputs first."""
        done: dict[str, bool] = {}

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise ValueError(f"derived tables go in a circle: {' -> '.join((*above, name))}")
            if name in self.nodes and name not in done:
                for i in self.nodes[name].inputs:
                    visit(i, (*above, name))
                done[name] = True

        for name in names:
            visit(name, ())
        return list(done)

    def refresh(self, sources: dict[str, DataFrame | Callable[[], DataFrame]], names: Iterable[str] | None = None) -> dict[str, str]:
        """Bring the named nodes (default: all) up to date; name -> "built" or "kept".
        A source may be a function that makes the DataFrame; only sources that are needed are read."""
        bound: dict[str, DataFrame] = {}
        prints: dict[str, str] = {}

        def source(name: str) -> DataFrame:
            if name not in bound:
                given = sources[name]
                bound[name] = given if isinstance(given, DataFrame) else given()
            return bound[name]

        done = {}
        for name in self._order(names or list(self.nodes)):
            node, table = self.nodes[name], self.table(name)
            for i in node.inputs:
                if i not in prints:  # an input that is no node is a source
                    prints[i] = row_fingerprint(source(i))
            prints[name] = _digest(node.definition(), *[prints[i] for i in node.inputs])
            stored = table.manifest()
            if stored is not None and stored.info.get("fingerprint") == prints[name]:
                done[name] = "kept"
                continue
            given = {i: self.read(i) if i in self.nodes else source(i) for i in node.inputs}
            table.replace(node.build(**given), info={"fingerprint": prints[name], "inputs": {i: prints[i] for i in node.inputs}})
            done[name] = "built"
        return done


# ---- the reports as nodes -------------------------------------------------


class _Asked:
    """Stands for Roles and notes which of them a report asks for."""

    def __init__(self, roles: Roles):
        self._roles, self.names = roles, []

    def __getattr__(self, name: str):
        if name not in self.names:
            self.names.append(name)
        return getattr(self._roles, name)


def _report_node(spark: SparkSession, roles: Roles, name: str) -> Node:
    """A report over the roles it reads (found by building it once, which runs nothing)."""
    asked = _Asked(roles)
    REPORTS[name](asked, spark)

    def build(**given: DataFrame) -> DataFrame:
        empty = {role: given.get(role) for role in SCHEMAS}
        return REPORTS[name](Roles(**{r: df if df is not None else (lambda r=r: getattr(roles, r)) for r, df in empty.items()},
                                   cleaned=given.get("paid_orders")), spark)

    return Node(name, tuple(asked.names), build, version=_source_of(REPORTS[name]))


def _source_of(report: Callable) -> str:
    """Code of the report's registration and of the functions it names."""
    own = [inspect.getsource(report)]
    for name in report.__code__.co_names:
        module = report.__globals__.get(name)
        if inspect.ismodule(module) and module.__name__.startswith("tradelens.operators"):
            own.append(inspect.getsource(module))
    return _digest(*own)


# Reports that start from a shared join instead of the roles.
SHARED = [
    Node("paid_orders", ("orders", "payments"), lambda orders, payments: audits.keep_paid_orders(orders, payments)),
    Node("ordered_items", ("items", "paid_orders"), lambda items, paid_orders: sales.ordered_items(items, paid_orders)),
    Node("merged_orders_payments", ("orders", "payments"), lambda orders, payments: sales.merged_orders_payments(orders, payments)),
    Node("monthly_orders_revenue_summary", ("merged_orders_payments",),
         lambda merged_orders_payments: sales.monthly_orders_revenue_summary(merged_orders_payments)),
    Node("monthly_category_revenue", ("ordered_items", "products", "translation"),
         lambda ordered_items, products, translation: sales.monthly_category_revenue_of(ordered_items, products, translation)),
    Node("category_sales_summary", ("ordered_items", "products", "translation"),
         lambda ordered_items, products, translation: sales.category_sales_summary_of(ordered_items, products, translation)),
    Node("seller_total_revenue", ("ordered_items",), lambda ordered_items: sales.seller_total_revenue_of(ordered_items)),
    Node("seller_revenue_review_summary", ("ordered_items", "reviews"),
         lambda ordered_items, reviews: sales.seller_revenue_review_summary_of(ordered_items, reviews)),
    Node("sellers_with_only_unfulfilled_orders", ("sellers", "ordered_items"),
         lambda sellers, ordered_items: audits.sellers_with_only_unfulfilled_orders_of(sellers, ordered_items)),
]


def report_tables(spark: SparkSession, roles: Roles, folder: str, names: Iterable[str] | None = None) -> DerivedTables:
    """The named reports (default: all that only read) and what they share, as nodes."""
    shared = {n.name: n for n in SHARED}
    wanted = [n for n in (names or REPORTS) if n not in shared]
    return DerivedTables(spark, folder, [*SHARED, *[_report_node(spark, roles, n) for n in wanted]])


def refresh_reports(spark: SparkSession, roles: Roles, folder: str, names: Iterable[str] | None = None) -> dict[str, str]:
    """Bring the reports under ``folder`` up to date with the roles; node -> "built" or "kept"."""
    names = list(names or REPORTS)
    tables = report_tables(spark, roles, folder, names)
    return tables.refresh({r: (lambda r=r: getattr(roles, r)) for r in SCHEMAS}, names)
