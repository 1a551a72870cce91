"""Plans and the registered queries; importing `all_queries` registers every one."""

from __future__ import annotations


def all_queries() -> None:
    from geoloom.plans import aggregating, joining, live, more, projecting, ranking, scalars, scans, sourced, written  # noqa: F401
