"""Area reports: a request is planned, areas are ranked, and the rows are formatted."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a report unless asked otherwise, and at most.
ROWS, MOST_ROWS = 50, 500


@dataclass
class Plan:
    rank_by: str
    order: str = "desc"
    limit: int = ROWS
    columns: list[str] = field(default_factory=list)
    state: str | None = None
    problems: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.problems


def planned(request: dict, known: list[str]) -> Plan:
    """A plan for a request (rank_by, order, limit, columns, state); what is not known is reported, not dropped."""
    problems = [f"unknown column: {c}" for c in [request.get("rank_by"), *request.get("columns", [])] if c and c not in known]
    order = request.get("order", "desc")
    if order not in ("asc", "desc"):
        problems.append(f"unknown order: {order}")
        order = "desc"
    limit = request.get("limit", ROWS)
    if not isinstance(limit, int) or limit < 1:
        problems.append(f"not a number of rows: {limit}")
        limit = ROWS
    columns = [c for c in request.get("columns", known) if c in known]
    rank_by = request.get("rank_by") if request.get("rank_by") in known else (columns or known)[0]
    return Plan(rank_by, order, min(limit, MOST_ROWS), columns, request.get("state"), problems)


def ranked(areas: DataFrame, plan: Plan, key: str = "geoid") -> DataFrame:
    """The first areas by the plan's measure (ties by key) with their rank and the number that have it.

    The order is a top-k of each partition and one merge; ranks are given to the few rows that are left.
    """
    if plan.state:
        areas = areas.where(F.col(key).startswith(plan.state))
    some = areas.where(F.col(plan.rank_by).isNotNull())
    by = F.col(plan.rank_by).desc() if plan.order == "desc" else F.col(plan.rank_by).asc()
    top = some.select(*dict.fromkeys([key, plan.rank_by, *plan.columns])).orderBy(by, key).limit(plan.limit)
    counted = some.agg(F.count(F.lit(1)).alias("eligible"))
    from pyspark.sql import Window as W

    return top.withColumn("rank", F.row_number().over(W.orderBy(by, key)).cast("long")).crossJoin(F.broadcast(counted))


def shown(value, kind: str) -> str:
    """A value as reports print it: count, percent, money, text; a missing one is a dash."""
    if value is None:
        return "—"
    return {"count": lambda v: f"{v:,.0f}", "percent": lambda v: f"{v:.1f}%", "money": lambda v: f"${v:,.0f}"}.get(kind, str)(value)


def table(rows: DataFrame, plan: Plan, kinds: dict[str, str]) -> tuple[list[str], list[list[str]]]:
    """Header and body of a report of at most MOST_ROWS rows."""
    body = [[str(r["rank"]), *(shown(r[c], kinds.get(c, "text")) for c in plan.columns)] for r in rows.orderBy("rank").limit(MOST_ROWS).collect()]
    return ["rank", *plan.columns], body


def csv(header: list[str], body: list[list[str]]) -> bytes:
    """CSV with a byte order mark and CRLF."""
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\r\n') else v
    return ("﻿" + "".join(",".join(map(quoted, row)) + "\r\n" for row in [header, *body])).encode()
