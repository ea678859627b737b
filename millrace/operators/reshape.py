"""Between wide and long records, and column standardisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slices of the labels of an axis of a cross-tab.
SLICES = 64


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], distinct: bool = True, extra: Sequence[str] = ("data_id", "unit")) -> DataFrame:
    """(ids, data_name, data_value text, empty extra columns); ``distinct`` drops repeated rows."""
    texts = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in values])
    long = texts.unpivot(list(ids), list(values), "data_name", "data_value")
    long = long.withColumns({c: F.lit(None).cast("string") for c in extra})
    return long.distinct() if distinct else long


def to_wide(
    long: DataFrame, keys: Sequence[str], masters: Sequence[str], name: str, value: str, order: Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """One row per key with a column per name (sorted); the last record in ``order`` wins.

    Names are looked up when not given.  Master columns come from the last record of the key.
    """
    if names is None:
        names = [r[0] for r in long.select(name).where(F.col(name).isNotNull()).distinct().collect()]
    at = F.struct(*order)
    aggs = [F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, at)).alias(n) for n in sorted(names)]
    last = [F.max_by(m, at).alias(m) for m in masters if m not in keys]
    wide = long.groupBy(*keys).agg(*last, *aggs)
    return wide.select(*dict.fromkeys([*masters, *keys]), *sorted(names))


def sub_part_history(df: DataFrame, part: str, tray: str, lot: str, serial: str) -> DataFrame:
    """Three sub-part columns as rows named ``SUB_..._<part[2:8]>``; rows without a sub part number go."""
    keep = [c for c in df.columns if c not in (part, tray, lot, serial)]
    short = F.substring(F.col(part), 3, 6)
    cells = [
        F.struct(F.concat(F.lit(f"{label}_"), short).alias("data_name"), F.col(c).cast("string").alias("data_value"))
        for c, label in ((tray, "SUB_TRAY_NO"), (lot, "SUB_LOT_NO"), (serial, "SUB_SERIAL"))
    ]
    out = df.where(F.col(part).isNotNull()).select(*keep, F.explode(F.array(*cells)).alias("_c"))
    return out.select(*keep, "_c.data_name", "_c.data_value")


# Old names of repeated sub-part columns -> new names.
REPEATED_NAMES = {"Shinaban": "Part", "Lot": "Lot", "Tray": "Tray", "Serial": "Serial"}


def rename_repeated(names: Sequence[str]) -> dict[str, str]:
    """``Ko{n}Shinaban`` and the like as ``Sub{n}Part``."""
    import re

    found = {}
    for n in names:
        m = re.match(r"^Ko(\d+)(Shinaban|Lot|Tray|Serial)$", n)
        if m:
            found[n] = f"Sub{m.group(1)}{REPEATED_NAMES[m.group(2)]}"
    return found


def repeated_groups(df: DataFrame, ids: Sequence[str], count: int, parts: Sequence[str] = ("Part", "Lot", "Tray", "Serial")) -> DataFrame:
    """``Sub{n}Part/Lot/Tray/Serial`` column groups as rows; 12-character part numbers keep their last four."""
    df = df.withColumnsRenamed(rename_repeated(df.columns))
    cells = []
    for n in range(1, count + 1):
        for p in parts:
            name = f"Sub{n}{p}"
            if name not in df.columns:
                continue
            text = F.col(name).cast("string")
            if p == "Part":
                text = F.when(text.rlike(r"^[a-zA-Z]{2}\d{10}$"), F.substring(text, -4, 4)).otherwise(text)
            cells.append(F.struct(F.lit(name).alias("data_name"), text.alias("data_value")))
    return df.select(*ids, F.explode(F.array(*cells)).alias("_c")).select(*ids, "_c.data_name", "_c.data_value")


def with_groups(df: DataFrame, columns: Sequence[str], groups: Sequence[str], out: str = "data_group") -> DataFrame:
    """Distinct combinations of some columns, each with every name of a fixed group list."""
    combos = df.select(*columns).distinct()
    return combos.withColumn(out, F.explode(F.array(*[F.lit(g) for g in groups])))


def parts_with_flag(df: DataFrame, part: str, sub_part: str) -> DataFrame:
    """Distinct part numbers; a number used as assembly keeps that flag even when it is also a sub part."""
    rows = df.select(F.explode(F.array(F.struct(F.col(part).alias("part_no"), F.lit(True).alias("assy")),
                                       F.struct(F.col(sub_part).alias("part_no"), F.lit(False).alias("assy")))).alias("p"))
    return rows.groupBy("p.part_no").agg(F.max("p.assy").alias("assy"))


def standard_columns(df: DataFrame, renames: Mapping[str, str], measures: Sequence[str], na_texts: Sequence[str]) -> DataFrame:
    """Id columns under their group names and measures with NA texts emptied."""
    cleaned = {m: F.when(~F.col(m).cast("string").isin(list(na_texts)), F.col(m)) for m in measures}
    return df.withColumns(cleaned).select(*[F.col(a).alias(b) for a, b in renames.items()], *measures)


def add_extra_rows(long: DataFrame, ids: Sequence[str], label: str, extra_id: str, value) -> DataFrame:
    """One more long row per distinct id tuple, carrying a derived value (e.g. the product of a line)."""
    extra = long.select(*ids).distinct().select(
        *ids, F.lit(extra_id).alias("data_id"), F.lit(label).alias("data_name"), value.alias("data_value")
    )
    return long.unionByName(extra.where(F.col("data_value").isNotNull()), allowMissingColumns=True)


def matrix_cells(df: DataFrame, x: str, y: str, agg, out: str, limit: int | None = None) -> DataFrame:
    """Cross-tab in long form with every pair of an x and a y label, empty cells included.

    The full grid is the result that is asked for: each distinct x label meets the distinct y labels a slice of them at a
    time, so no task holds all labels of an axis.
    ``limit`` keeps the first labels of each axis for a display.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def labels(c):
        found = known.select(c).distinct()
        return found.orderBy(c).limit(limit) if limit else found

    slices = labels(y).groupBy(F.pmod(F.xxhash64(y), F.lit(SLICES)).alias("_slice")).agg(F.collect_list(y).alias("_some"))
    along = labels(x).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))))
    grid = along.join(slices, "_slice").select(x, F.explode("_some").alias(y))
    cells = known.groupBy(x, y).agg(agg.alias(out))
    return grid.join(cells, [x, y], "left")


def number_names(names: Sequence[str]) -> list[str]:
    """Column names made unique with ``_01``-style suffixes, in order of appearance."""
    seen: dict[str, int] = {}
    out: list[str] = []
    taken = set(names)
    for n in names:
        if n not in seen:
            seen[n] = 0
            out.append(n)
            continue
        while True:
            seen[n] += 1
            fresh = f"{n}_{seen[n]:02d}"
            if fresh not in taken:
                break
        taken.add(fresh)
        out.append(fresh)
    return out


