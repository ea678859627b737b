"""Master data: star joins, resolution, tolerant matching and category dictionaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import ordering
from millrace.operators.lookup import look_up


def star_join(df: DataFrame, dims: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left join of (dimension, fact key, dimension key).

    A dimension is counted first: a small one is broadcast, a large one salted, so a hot or NULL key meets no one task.
    """
    for dim, key, dim_key in dims:
        renamed = dim.withColumnRenamed(dim_key, "_dk") if dim_key != key else dim.select("*", F.col(dim_key).alias("_dk")).drop(dim_key)
        df = look_up(df, renamed, [(F.col(key), "_dk")])
    return df


def resolve(df: DataFrame, dims: Sequence[tuple[DataFrame, Mapping[str, str]]]) -> tuple[DataFrame, DataFrame]:
    """(resolved rows, rows with an unknown master): a chain of inner joins on text keys, NULL read as empty.

    Each step maps fact columns to dimension columns; repeated dimension keys are dropped first.
    """
    columns = df.columns
    known, unknown = df, df.limit(0)
    for dim, keys in dims:
        plain = dim.withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit("")) for d in keys.values()})
        plain = plain.dropDuplicates(list(keys.values()))
        renamed = plain.withColumnsRenamed({d: f"_d_{d}" for d in keys.values()})
        cond = [F.coalesce(F.col(f).cast("string"), F.lit("")) == F.col(f"_d_{d}") for f, d in keys.items()]
        missing = known.join(renamed, cond, "left_anti").select(*columns)
        unknown = unknown.unionByName(missing)
        known = known.join(renamed, cond, "inner").drop(*[f"_d_{d}" for d in keys.values()])
    return known, unknown


def new_masters(found: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct master rows that are not stored yet (NULL equals NULL)."""
    renamed = stored.select(*[F.col(k).alias(f"_s_{k}") for k in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]
    return found.select(*keys).distinct().join(renamed, cond, "left_anti")


def loose(text: Column) -> Column:
    """Lower case with punctuation and spaces as single spaces."""
    spaced = F.regexp_replace(text, r"[:\s()/_]+", " ")
    return F.lower(F.regexp_replace(spaced, r"\s+$", ""))


def spaceless(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s", ""))


def match_masters(df: DataFrame, masters: DataFrame, names: Sequence[str], id_col: str, system_names: Sequence[str] = ()) -> DataFrame:
    """Master id by exact name, else ignoring case and punctuation, else by system name, else ignoring spaces.

    Matching runs on the distinct names; each step keeps the smallest id when several masters agree.
    """
    wanted = df.select(*names, *system_names).distinct()
    steps: list[tuple[str, Sequence[str], object]] = [("exact", names, lambda c: c), ("loose", names, loose)]
    if system_names:
        steps.append(("system", system_names, lambda c: c))
    steps.append(("spaceless", names, spaceless))
    out = wanted
    for label, cols, fold in steps:
        side = masters.groupBy(*[fold(F.col(c)).alias(f"_m{i}") for i, c in enumerate(cols)]).agg(F.min(id_col).alias(f"_{label}"))
        cond = [fold(F.col(c)) == F.col(f"_m{i}") for i, c in enumerate(cols)]
        out = out.join(side, cond, "left").drop(*[f"_m{i}" for i in range(len(cols))])
    found = F.coalesce(*[F.col(f"_{label}") for label, _, _ in steps])
    out = out.select(*[F.col(c).alias(f"_w_{c}") for c in (*names, *system_names)], found.alias(id_col))
    cond = [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in (*names, *system_names)]
    return df.join(out, cond, "left").drop(*[f"_w_{c}" for c in (*names, *system_names)])


def hover_ids(df: DataFrame, value: str, ids: Sequence[str]) -> DataFrame:
    """(value, id column, id): the distinct master ids behind each displayed value, in long form."""
    pairs = [F.struct(F.lit(c).alias("master"), F.col(c).cast("string").alias("id")) for c in ids]
    long = df.select(F.col(value).alias("value"), F.explode(F.array(*pairs)).alias("p")).select("value", "p.master", "p.id")
    return long.where(F.col("id").isNotNull()).distinct()


def relationship_index(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Distinct rows as one index per column group (0-based in sorted order, NULL read as empty)."""
    cols = list(dict.fromkeys(c for g in groups.values() for c in g))
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols]).distinct()
    for name, keys in groups.items():
        numbered = ordering.row_numbers(rows.select(*keys).distinct(), list(keys), out=name)
        rows = rows.join(numbered.withColumn(name, F.col(name) - 1), list(keys), "left")
    return rows.select(*groups).distinct()


def grow_dictionary(df: DataFrame, col: str, dictionary: DataFrame | None) -> DataFrame:
    """(value, factor): stored entries kept, new values numbered on in sorted order from the largest factor."""
    values = df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("value")).distinct()
    if dictionary is None:
        return ordering.row_numbers(values, ["value"], out="factor")
    fresh = values.join(dictionary, "value", "left_anti")
    start = dictionary.agg(F.max("factor")).first()[0] or 0
    numbered = ordering.row_numbers(fresh, ["value"], out="factor").withColumn("factor", F.col("factor") + F.lit(start))
    return dictionary.select("value", F.col("factor").cast("long")).unionByName(numbered)


def encode_category(df: DataFrame, col: str, dictionary: DataFrame, out: str) -> DataFrame:
    entries = dictionary.select(F.col("value").alias("_v"), F.col("factor").alias(out))
    return look_up(df, entries, [(F.col(col).cast("string"), "_v")])


def decode_category(df: DataFrame, factor: str, dictionary: DataFrame, out: str, kind: str = "string") -> DataFrame:
    """Value of a factor (left join), cast back to a plain type when asked."""
    entries = dictionary.select(F.col("factor").alias("_f"), F.col("value").alias(out))
    return look_up(df, entries, [(F.col(factor), "_f")]).withColumn(out, F.col(out).try_cast(kind))


def regroup_dictionary(entries: DataFrame, groups: Mapping[int, int]) -> DataFrame:
    """(group_id, value, factor) after merging data ids into groups: equal values of one group share a factor."""
    spark = entries.sparkSession
    table = spark.createDataFrame(list(groups.items()), "data_id long, group_id long")
    merged = entries.join(table, "data_id", "left").withColumn("group_id", F.coalesce("group_id", "data_id"))
    return ordering.row_numbers(merged.select("group_id", "value").distinct(), ["value"], ["group_id"], "factor")


def ungroup_dictionary(used: DataFrame, grouped: DataFrame, groups: Mapping[int, int]) -> DataFrame:
    """(data_id, value, factor, group_factor) after data ids have left their groups.

    ``used(data_id, value)`` are the values each data id has, ``grouped(group_id, value, factor)`` the dictionary of
    the groups.  Every data id numbers its own values from 1 again; ``group_factor`` is what its rows hold so far.
    """
    table = used.sparkSession.createDataFrame(list(groups.items()), "data_id long, group_id long")
    member = used.distinct().join(F.broadcast(table), "data_id", "left").withColumn("group_id", F.coalesce("group_id", "data_id"))
    held = grouped.select("group_id", "value", F.col("factor").alias("group_factor"))
    numbered = ordering.row_numbers(member.join(held, ["group_id", "value"], "left"), ["value"], ["data_id"], "factor")
    return numbered.select("data_id", "value", "factor", "group_factor")


def category_or_plain(df: DataFrame, col: str, dictionary: DataFrame, limit: int = 256) -> tuple[DataFrame, DataFrame | None]:
    """(rows, dictionary) of a factor column: decoded to plain values, without a dictionary, once this has more than
    ``limit`` entries; else as it is."""
    if dictionary.limit(limit + 1).count() <= limit:
        return df, dictionary
    decoded = decode_category(df.withColumnRenamed(col, "_factor"), "_factor", dictionary, col).drop("_factor")
    return decoded.select(*df.columns), None


def number_repeated_names(df: DataFrame, process: str, name: str, data_id: str, out: str = "unique_name") -> DataFrame:
    """Repeated data names of a process get ``_NN``: the lowest data id keeps its name, the rest are numbered on
    from the largest suffix already in use."""
    suffix = F.regexp_extract(F.col(name), r"^(.*)_(\d{2})$", 2)
    base = F.when(suffix != "", F.regexp_extract(F.col(name), r"^(.*)_(\d{2})$", 1)).otherwise(F.col(name))
    framed = df.withColumns({"_base": base, "_suffix": F.when(suffix != "", suffix.cast("int"))})
    used = framed.groupBy(process, "_base").agg(F.max("_suffix").alias("_most"))
    numbered = ordering.row_numbers(framed, [data_id], [process, name], "_rn")
    repeated = numbered.where(F.col("_rn") > 1).select(process, "_base", name, data_id)
    extra = ordering.row_numbers(repeated, [data_id], [process, "_base"], "_extra")
    extra = extra.select(F.col(process).alias("_p"), F.col(name).alias("_n"), F.col(data_id).alias("_d"), "_extra")
    joined = numbered.join(extra, [F.col(process) == F.col("_p"), F.col(name) == F.col("_n"), F.col(data_id) == F.col("_d")], "left")
    most = used.select(F.col(process).alias("_up"), F.col("_base").alias("_ub"), "_most")
    joined = joined.join(most, [F.col(process) == F.col("_up"), F.col("_base") == F.col("_ub")], "left")
    number = F.coalesce("_most", F.lit(0)) + F.col("_extra")
    label = F.concat(F.col("_base"), F.lit("_"), F.lpad(number.cast("string"), 2, "0"))
    return joined.withColumn(out, F.when(F.col("_extra").isNull(), F.col(name)).otherwise(label)).select(*df.columns, out)


def longest_contained(df: DataFrame, text: str, names: DataFrame, name: str, out: str) -> DataFrame:
    """``df`` with the longest of ``names`` that its text contains (of several the first in code point order), else NULL.

    Each distinct text gives its parts of the lengths that names have, which are joined with the names by equality: no
    name is searched in every text, and neither side has to be small.
    """
    known = names.select(F.col(name).alias("_name")).where(F.length("_name") > 0).distinct()
    lengths = sorted(r[0] for r in known.select(F.length("_name")).distinct().collect())  # as many as there are lengths
    texts = df.select(F.col(text).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    parts = texts.select("_text", F.explode(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")).alias("_size"))
    parts = parts.where(F.length("_text") >= F.col("_size"))
    parts = parts.select("_text", F.explode(F.sequence(F.lit(1), F.length("_text") - F.col("_size") + 1)).alias("_at"), "_size")
    parts = parts.select("_text", F.expr("substring(_text, _at, _size)").alias("_name")).distinct()
    best = parts.join(known, "_name").groupBy("_text").agg(F.min(F.struct((-F.length("_name")).alias("less"), "_name")).alias("_best"))
    return look_up(df, best.select("_text", F.col("_best._name").alias(out)), [(F.col(text), "_text")])
