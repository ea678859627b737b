"""Plain descriptions of processes, links, filters and analysis requests."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from enum import Enum

from millrace.functions.equations import EquationSpec


class DuplicateShow(Enum):
    """What to show when several records share a link key."""

    BOTH = "both"
    FIRST = "first"
    LAST = "last"


@dataclass(frozen=True)
class LinkKey:
    """One pair of linked columns.

    ``*_substr`` are 1-based inclusive positions.  ``delta_minutes`` on one side makes the pair a time link: the
    other side must lie strictly within ``delta ± cut_off`` minutes of it and be later, or, where ``earlier`` is set
    because the link is followed against its direction, earlier.
    """

    self_column: str
    target_column: str
    self_substr: tuple[int, int] | None = None
    target_substr: tuple[int, int] | None = None
    delta_minutes: float | None = None
    cut_off_minutes: float = 0.0
    earlier: bool = False

    def reversed(self) -> "LinkKey":
        delta = None if self.delta_minutes is None else -self.delta_minutes
        earlier = self.earlier if delta is None else not self.earlier
        return LinkKey(self.target_column, self.self_column, self.target_substr, self.self_substr, delta, self.cut_off_minutes, earlier)


@dataclass(frozen=True)
class LinkEdge:
    """Directed edge between two processes."""

    self_process: str
    target_process: str
    keys: tuple[LinkKey, ...]

    def reversed(self) -> "LinkEdge":
        return LinkEdge(self.target_process, self.self_process, tuple(k.reversed() for k in self.keys))


@dataclass(frozen=True)
class ProcessSpec:
    """One process table: its record id, event time, serial columns and measured columns."""

    name: str
    id: str
    time: str
    serials: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class FilterSpec:
    """One condition of a column filter.  Values of one filter are OR-ed, filters are AND-ed."""

    column: str
    op: str
    values: tuple = ()
    position: int = 1


@dataclass
class AnalysisSpec:
    """Which records to link and how to prepare them."""

    start_process: str
    start: datetime
    end: datetime
    end_columns: dict[str, list[str]]
    filters: dict[str, list[FilterSpec]] = field(default_factory=dict)
    equations: list[EquationSpec] = field(default_factory=list)
    duplicates: DuplicateShow = DuplicateShow.BOTH
    on_demand: dict[str, list] = field(default_factory=dict)
    outlier: str | None = None
    outlier_columns: list[str] = field(default_factory=list)
    discretise: list[str] = field(default_factory=list)
    drop_abnormal_counts: bool = False
    sentinels: bool = True
    buffer_days: int = 14
