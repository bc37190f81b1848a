"""Typed queries: a registry of handlers, declared filters, sorting, paging, signed cursors and version tags."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_DEFAULT, PAGE_MOST, CURSOR_MOST = 50, 200, 4096


class QueryRefused(ValueError):
    """A query that breaks a rule; ``reason`` names it."""

    def __init__(self, reason: str, text: str = ""):
        super().__init__(f"{reason}: {text}" if text else reason)
        self.reason = reason


OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "contains": lambda c, v: F.contains(F.lower(c), F.lit(str(v).lower())),
    "startswith": lambda c, v: F.startswith(F.lower(c), F.lit(str(v).lower())),
    "any": lambda c, v: F.arrays_overlap(c, F.array(*map(F.lit, v))),
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
}


@dataclass(frozen=True)
class Request:
    """A query of one tenant; ``filters`` are (column, operator, value), ``order`` (column, 'asc' or 'desc')."""

    domain: str
    kind: str
    tenant: str
    filters: Sequence[tuple[str, str, object]] = ()
    order: Sequence[tuple[str, str]] = ()
    search: str | None = None
    size: int = PAGE_DEFAULT
    offset: int | None = None
    cursor: str | None = None
    parameters: Mapping[str, object] = field(default_factory=dict)

    def check(self) -> None:
        if not self.tenant or not self.domain or not self.kind:
            raise QueryRefused("Required", "tenant, domain and query type")
        if not 1 <= self.size <= PAGE_MOST:
            raise QueryRefused("PageSize", f"1 to {PAGE_MOST}")
        if self.cursor is not None and self.offset is not None:
            raise QueryRefused("CursorAndOffset")
        if self.offset is not None and self.offset < 0:
            raise QueryRefused("Offset")
        if self.cursor is not None and len(self.cursor) > CURSOR_MOST:
            raise QueryRefused("CursorLength")


class Cursors:
    """Cursors {version, query type, scope, position}, signed so that a changed one is refused."""

    VERSION = 1

    def __init__(self, secret: bytes):
        self.secret = secret

    def write(self, kind: str, scope: str, position: list) -> str:
        body = json.dumps([self.VERSION, kind, scope, position], separators=(",", ":"), default=str).encode()
        sign = hmac.new(self.secret, body, hashlib.sha256).digest()
        return base64.urlsafe_b64encode(sign + body).decode().rstrip("=")

    def read(self, text: str, kind: str, scope: str) -> list:
        try:
            raw = base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True)
        except ValueError:
            raise QueryRefused("Malformed") from None
        sign, body = raw[:32], raw[32:]
        if not hmac.compare_digest(sign, hmac.new(self.secret, body, hashlib.sha256).digest()):
            raise QueryRefused("Tampered")
        version, own_kind, own_scope, position = json.loads(body)
        if version != self.VERSION:
            raise QueryRefused("Version")
        if own_kind != kind:
            raise QueryRefused("QueryType")
        if own_scope != scope:
            raise QueryRefused("Scope")
        return position


def scope(*parts: str, watermark: int | None = None) -> str:
    """Parts of a cursor's scope, joined so that no two lists of parts give the same text; a position ``watermark`` must be positive."""
    if watermark is not None:
        if watermark < 1:
            raise QueryRefused("Watermark")
        parts = (*parts, f"watermark={watermark}")
    return ":".join(p.replace("\\", "\\\\").replace("|", "\\p").replace(":", "\\c") for p in parts)


def filtered(rows: DataFrame, request: Request, searched: Sequence[str] = ()) -> DataFrame:
    """Apply the tenant, the filters and the search text; unknown columns and operators are refused."""
    out = rows.where(F.col("tenant_id") == request.tenant.lower())
    for column, operator, value in request.filters:
        if column not in rows.columns or operator not in OPERATORS:
            raise QueryRefused("Filter", f"{column} {operator}")
        out = out.where(OPERATORS[operator](F.col(column), value))
    if request.search:
        hit = F.lit(False)
        for column in searched:
            hit = hit | F.contains(F.lower(F.col(column)), F.lit(request.search.lower()))
        out = out.where(hit)
    return out


def ordering(request: Request, unique: Sequence[str]) -> list[tuple[str, bool]]:
    """(column, descending) of the declared order, then the unique columns, so that pages don't depend on luck."""
    named = [(c, d.lower() == "desc") for c, d in request.order]
    return named + [(c, False) for c in unique if c not in {n for n, _ in named}]


def after(order: Sequence[tuple[str, bool]], position: Sequence) -> Column:
    """Rows behind a position in an order: the keyset condition. Nulls come first in a rising order and last in a falling one, as the sort places them."""
    out, same = F.lit(False), F.lit(True)
    for (column, down), value in zip(order, position, strict=True):
        c = F.col(column)
        if value is None:
            beyond = F.lit(False) if down else c.isNotNull()
        else:
            beyond = (c < F.lit(value)) | c.isNull() if down else c > F.lit(value)
        out = out | (same & F.coalesce(beyond, F.lit(False)))
        same = same & c.eqNullSafe(F.lit(value))
    return out


@dataclass(frozen=True)
class Page:
    rows: list
    next_cursor: str | None
    next_offset: int | None


class Registry:
    """Handlers by (domain, query type): functions of the log and the request that return a DataFrame."""

    def __init__(self, cursors: Cursors):
        self.cursors = cursors
        self.handlers: dict[tuple[str, str], tuple[Callable, tuple[str, ...], tuple[str, ...]]] = {}

    def query(self, domain: str, kind: str, unique: Sequence[str], searched: Sequence[str] = ()):
        def add(handler):
            if (domain, kind) in self.handlers:
                raise QueryRefused("Duplicate", f"{domain} {kind}")
            self.handlers[domain, kind] = handler, tuple(unique), tuple(searched)
            return handler

        return add

    def plan(self, log: DataFrame, request: Request) -> tuple[DataFrame, list[tuple[str, bool]]]:
        request.check()
        if (request.domain, request.kind) not in self.handlers:
            raise QueryRefused("UnknownQuery", f"{request.domain} {request.kind}")
        handler, unique, searched = self.handlers[request.domain, request.kind]
        return filtered(handler(log, request), request, searched), ordering(request, unique)

    def page(self, log: DataFrame, request: Request) -> Page:
        """One page of at most 200 rows; a row more is fetched to tell whether another follows."""
        rows, order = self.plan(log, request)
        own = scope(request.tenant, request.domain, str(sorted(map(str, request.filters))), str(order), request.search or "")
        if request.cursor is not None:
            rows = rows.where(after(order, self.cursors.read(request.cursor, request.kind, own)))
        rows = rows.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order])
        if request.offset:
            rows = rows.offset(request.offset)
        got = rows.limit(request.size + 1).collect()
        more, got = len(got) > request.size, got[: request.size]
        cursor = self.cursors.write(request.kind, own, [got[-1][c] for c, _ in order]) if more else None
        return Page(got, cursor, (request.offset or 0) + request.size if more and request.cursor is None else None)


def tag(kind: str, log: DataFrame) -> str:
    """A version tag of a query type: the log's head and size."""
    head = log.agg(F.max("global_position").alias("p"), F.count("*").alias("n")).first()
    name = base64.urlsafe_b64encode(kind.encode()).decode().rstrip("=")
    return f"{name}.{hashlib.sha256(f'{head.p} {head.n}'.encode()).hexdigest()[:32]}"


def not_modified(current: str, sent: str | None) -> bool:
    """Whether a list of at most ten tags holds the current one; a star never does."""
    tags = [t.strip().strip('"') for t in (sent or "").split(",") if t.strip()]
    return 0 < len(tags) <= 10 and "*" not in tags and current in tags
