"""The tree of a statement."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

Expr = Any


@dataclass(frozen=True)
class Literal:
    value: Any  # int, float, str, bool or None


@dataclass(frozen=True)
class Point:
    lat: float
    lon: float


@dataclass(frozen=True)
class Polygon:
    rings: tuple[tuple[tuple[float, float], ...], ...]  # the outer ring, then holes; (lat, lon)


@dataclass(frozen=True)
class Ref:
    column: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str  # + - NOT
    arg: Expr


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull:
    arg: Expr
    negated: bool = False


@dataclass(frozen=True)
class Between:
    arg: Expr
    low: Expr
    high: Expr
    negated: bool = False


@dataclass(frozen=True)
class InList:
    arg: Expr
    items: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class Like:
    arg: Expr
    pattern: Expr
    negated: bool = False


@dataclass(frozen=True)
class Aggregate:
    name: str  # COUNT SUM AVG MIN MAX
    arg: Expr | None  # None: COUNT(*)
    distinct: bool = False


@dataclass(frozen=True)
class Distance:
    left: Expr
    right: Expr
    metric: str | None = None


@dataclass(frozen=True)
class Within:
    point: Expr
    polygon: Expr


@dataclass(frozen=True)
class Match:
    column: Ref
    query: str
    ranking: str  # TF_IDF or BM25


@dataclass(frozen=True)
class SimilarTo:
    column: Ref | None
    path: str
    k: int
    method: str  # HNSW or IVF
    metric: str | None = None


@dataclass(frozen=True)
class Score:
    pass


@dataclass(frozen=True)
class SimilarityScore:
    pass


@dataclass(frozen=True)
class SelectItem:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str


@dataclass(frozen=True)
class Join:
    table: TableRef
    on: Expr


@dataclass(frozen=True)
class OrderItem:
    expr: Expr
    descending: bool = False
    nulls_first: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[SelectItem, ...]
    table: TableRef
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    having: Expr | None = None
    order_by: tuple[OrderItem, ...] = ()
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False


@dataclass(frozen=True)
class ForeignKey:
    column: str
    table: str
    target: str | None
    on_delete: str = "RESTRICT"


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str  # INT FLOAT VARCHAR TEXT POINT IMAGE AUDIO
    size: int | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: str | None = None
    foreign_keys: tuple[ForeignKey, ...] = ()
    organisation: str = "HEAP"


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str
    method: str
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class Copy:
    table: str
    columns: tuple[str, ...] | None
    path: str
    header: bool = False
    delimiter: str = ","
    encoding: str = "UTF8"


@dataclass(frozen=True)
class Delete:
    table: TableRef
    where: Expr | None = None


@dataclass(frozen=True)
class Transaction:
    action: str  # BEGIN COMMIT ROLLBACK


@dataclass(frozen=True)
class Explain:
    statement: Any
    analyze: bool = False
