"""From a link configuration to a chain of joins, and the fixed preparation order of an analysis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import cleaning, derive, filters, links
from millrace.session import settle
from millrace.spec import AnalysisSpec, DuplicateShow, LinkEdge, ProcessSpec


class LinkGraph:
    """The configured links; a handful of edges, searched on the driver."""

    def __init__(self, edges: Sequence[LinkEdge]):
        self.edges = {(e.self_process, e.target_process): e for e in edges}
        self.forward: dict[str, list[str]] = {}
        self.both: dict[str, list[str]] = {}
        for a, b in self.edges:
            self.forward.setdefault(a, []).append(b)
            self.both.setdefault(a, []).append(b)
            self.both.setdefault(b, []).append(a)

    def edge(self, a: str, b: str) -> LinkEdge:
        """The edge from a to b, flipped when it is configured the other way round."""
        return self.edges[(a, b)] if (a, b) in self.edges else self.edges[(b, a)].reversed()

    def _walk(self, near: Mapping[str, list[str]], start: str, end: str) -> list[list[str]]:
        done, open_paths = [], [[start]]
        while open_paths:
            path = open_paths.pop(0)
            if path[-1] == end:
                done.append(path)
                continue
            open_paths += [[*path, n] for n in near.get(path[-1], []) if n not in path]
        return done

    def paths(self, start: str, end: str) -> list[list[str]]:
        """Paths along the edges, else against them, else ignoring direction; always listed from ``start``."""
        ahead = self._walk(self.forward, start, end)
        if ahead:
            return ahead
        back = self._walk(self.forward, end, start)
        if back:
            return [p[::-1] for p in back]
        return self._walk(self.both, start, end)

    def _key_on(self, middle: str, other: str) -> tuple | None:
        """What a link compares on the middle process; None for time links, which are never merged."""
        if (other, middle) in self.edges:
            keys = [(k.target_column, k.target_substr, k.delta_minutes) for k in self.edges[(other, middle)].keys]
        else:
            keys = [(k.self_column, k.self_substr, k.delta_minutes) for k in self.edges[(middle, other)].keys]
        return None if any(k[2] is not None for k in keys) else tuple(k[:2] for k in keys)

    def shorten(self, path: Sequence[str], needed: Sequence[str] = ()) -> list[str]:
        """Drop pass-through processes whose two links compare the same columns."""
        kept = list(path[:1])
        for before, middle, after in zip(path, path[1:], path[2:]):
            left, right = self._key_on(middle, before), self._key_on(middle, after)
            if middle in needed or left is None or left != right:
                kept.append(middle)
        return kept + ([path[-1]] if len(path) > 1 else [])

    def chain(self, path: Sequence[str], needed: Sequence[str] = ()) -> list[LinkEdge]:
        """Edges to join along a shortened path; a skipped process leaves an edge between its neighbours."""
        kept = self.shorten(path, needed)
        out = []
        for a, b in zip(kept, kept[1:]):
            if (a, b) in self.edges or (b, a) in self.edges:
                out.append(self.edge(a, b))
                continue
            i, j = list(path).index(a), list(path).index(b)
            first, last = self.edge(path[i], path[i + 1]), self.edge(path[j - 1], path[j])
            keys = tuple(
                type(f)(f.self_column, t.target_column, f.self_substr, t.target_substr)
                for f, t in zip(first.keys, last.keys)
            )
            out.append(LinkEdge(a, b, keys))
        return out


def longest_paths(paths: Sequence[Sequence[str]]) -> list[list[str]]:
    """Paths that are not the beginning of another one."""
    out: list[list[str]] = []
    for path in sorted(paths, key=len, reverse=True):
        if len(path) > 1 and not any(list(path) == o[: len(path)] for o in out):
            out.append(list(path))
    return out


def _labelled(df: DataFrame, process: ProcessSpec) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{process.name}__{c}") for c in df.columns])


def trace(
    spec: AnalysisSpec, graph: LinkGraph, processes: Mapping[str, ProcessSpec], tables: Mapping[str, DataFrame]
) -> DataFrame:
    """Link all end processes of a request to its start process; columns are named ``process__column``."""
    first = processes[spec.start_process]
    wanted = [p for p in spec.end_columns if p != spec.start_process]
    paths = longest_paths([p for end in wanted for p in graph.paths(spec.start_process, end)])
    needed = {*spec.end_columns, *spec.filters}
    after, before = links.end_window(spec.start, spec.end, spec.buffer_days)

    def rows(name: str) -> DataFrame:
        process = processes[name]
        lo, hi = (spec.start, spec.end) if name == spec.start_process else (after, before)
        df = links.time_window(tables[name], process.time, lo, hi)
        return filters.apply_filters(df, [spec.filters.get(name, [])])

    def keyed(name: str, columns: Sequence[str]) -> DataFrame:
        process, df = processes[name], rows(name)
        columns = [c for c in dict.fromkeys(columns) if c != process.time]
        df = links.one_per_key(df, columns, process.time, [process.id], spec.duplicates)
        return _labelled(df, process)

    start_id = f"{first.name}__{first.id}"
    result = None
    for path in paths:
        edges = graph.chain(path, needed)
        joined = keyed(path[0], [k.self_column for k in edges[0].keys if k.delta_minutes is None])
        for edge in edges:
            joined = _join(joined, edge, processes, keyed, spec)
        joined = links.one_per_start(joined, start_id, [(f"{edges[-1].target_process}__{processes[edges[-1].target_process].time}",
                                                         "asc" if spec.duplicates is DuplicateShow.FIRST else "desc"),
                                                        f"{edges[-1].target_process}__{processes[edges[-1].target_process].id}"])
        result = joined if result is None else links.combine_paths(result, joined, start_id)
    return _labelled(rows(first.name), first) if result is None else result


def _join(joined, edge, processes, keyed, spec):
    a, b = edge.self_process, edge.target_process
    plain = [k for k in edge.keys if k.delta_minutes is None]
    timed = [k for k in edge.keys if k.delta_minutes is not None]
    right = keyed(b, [k.target_column for k in plain])
    named = [
        type(k)(f"{a}__{k.self_column}", f"{b}__{k.target_column}", k.self_substr, k.target_substr) for k in plain
    ]
    filtered = bool(spec.filters.get(b))
    if not timed:
        if spec.duplicates is DuplicateShow.BOTH:
            left_keys, right_keys = [k.self_column for k in named], [k.target_column for k in named]
            la, rb = processes[a], processes[b]
            joined = links.number_duplicates(joined, left_keys, f"{a}__{la.time}", [f"{a}__{la.id}"], "_na")
            right = links.number_duplicates(right, right_keys, f"{b}__{rb.time}", [f"{b}__{rb.id}"], "_nb")
            named = [*named, type(edge.keys[0])("_na", "_nb")]
            return links.equi_link(joined, right, named, filtered, find="").drop("_na", "_nb")
        return links.equi_link(joined, right, named, filtered, find="")  # the linked side has a key once
    if len(timed) > 1:
        raise ValueError("one time link per edge")
    t = timed[0]
    return links.time_link(
        joined, right, f"{a}__{t.self_column}", f"{b}__{t.target_column}", t.delta_minutes, t.cut_off_minutes, named, filtered, t.earlier
    )


def prepare_analysis(df: DataFrame, spec: AnalysisSpec, order: Sequence[str]) -> DataFrame:
    """The fixed order: sentinels, equations, discretise, on-demand filter, abnormal counts, outliers.

    Steps that look at all values before they change any read the rows several times; the joins behind the rows are
    then run once and their result is kept in the shared checkpoint folder.
    """
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "string")]
    if spec.sentinels:
        df = cleaning.replace_sentinels(df, [c for c in spec.outlier_columns if c in numeric])
    df = derive.apply_equations(df, spec.equations, order)
    if spec.discretise or spec.drop_abnormal_counts or spec.outlier:
        df = settle(df)
    for name in spec.discretise:
        df = derive.discretise(df, name)
    df = filters.on_demand(df, spec.on_demand)
    if spec.drop_abnormal_counts:
        for name in spec.outlier_columns:
            df = cleaning.drop_abnormal_counts(df, name)
    if spec.outlier:
        df = filters.remove_outliers(df, spec.outlier_columns, spec.outlier)
    return df
