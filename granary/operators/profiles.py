"""Configurations: profiles of several types with one active of each, settings validated by name and bound, overrides of one run.

profiles(profile_id, name, type, config map<string,string>, ord, update_time) and active(type, profile_id) are tables; each change is a new version of both. Settings are handed on as
columns or as an immutable ``ChunkConfig``: nothing is global, so runs with different settings go on side by side.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.config import STRATEGIES, ChunkConfig
from granary.functions.structure import let


@dataclass(frozen=True)
class Field:
    """A key that a profile may have, its default, and the types it is for (none: all)."""

    key: str
    default: str | None = None
    types: tuple[str, ...] = ()


def merged(base: Column, own: Column, known: list[Field], kind: Column) -> Column:
    """A profile's configuration: known keys of its own over the base, null included; keys that are not for its type have their defaults."""
    value = lambda f: F.when(F.array_contains(F.map_keys(own), f.key), own[f.key]).otherwise(base[f.key])
    held = lambda f: F.when(kind.isin(*f.types), value(f)).otherwise(F.lit(f.default)) if f.types else value(f)
    return F.map_from_arrays(F.array(*(F.lit(f.key) for f in known)), F.array(*(held(f).cast("string") for f in known)))


def defaults(known: list[Field]) -> Column:
    return F.map_from_arrays(F.array(*(F.lit(f.key) for f in known)), F.array(*(F.lit(f.default).cast("string") for f in known)))


def created(profiles: DataFrame, active: DataFrame, wanted: DataFrame, known: list[Field], types: list[str], now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """wanted(profile_id, name, type, config, ord) as new profiles: (profiles, active, denied). A type without an active profile activates the first new one; an unknown type is denied."""
    ok = F.col("type").isin(types)
    name = F.btrim(F.coalesce("name", F.lit("")))
    config = F.coalesce("config", F.create_map().cast("map<string,string>"))
    rows = wanted.where(ok).select("profile_id", F.when(name == "", F.concat(F.lit("profile "), F.lit(now))).otherwise(name).alias("name"), "type", merged(defaults(known), config, known, F.col("type")).alias("config"), "ord", F.lit(now).alias("update_time"))
    first = rows.groupBy("type").agg(F.min_by("profile_id", "ord").alias("profile_id")).join(active.select("type"), "type", "left_anti")
    return profiles.unionByName(rows), active.unionByName(first), wanted.where(~F.coalesce(ok, F.lit(False))).select("profile_id", F.lit("unknown type").alias("denied"))


def updated(profiles: DataFrame, changes: DataFrame, known: list[Field], now: str) -> DataFrame:
    """changes(profile_id, name, config): a blank name and a null configuration change nothing; every profile named gets the time."""
    c = changes.select("profile_id", F.nullif(F.btrim("name"), F.lit("")).alias("new_name"), F.col("config").alias("new_config"), F.lit(True).alias("named"))
    rows = profiles.join(c, "profile_id", "left")
    config = F.when(F.col("new_config").isNotNull(), merged(F.col("config"), F.col("new_config"), known, F.col("type"))).otherwise(F.col("config"))
    return rows.select("profile_id", F.coalesce("new_name", "name").alias("name"), "type", config.alias("config"), "ord", F.when(F.col("named"), now).otherwise(F.col("update_time")).alias("update_time"))


def deleted(profiles: DataFrame, active: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles without those named; where the active one of a type goes, the first that is left of that type follows it."""
    left = profiles.join(ids.select("profile_id").distinct(), "profile_id", "left_anti")
    stays = active.join(left.select("profile_id"), "profile_id", "left_semi").select("type", "profile_id")
    next_ = left.groupBy("type").agg(F.min_by("profile_id", "ord").alias("profile_id"))
    return left, stays.unionByName(next_.join(active.select("type"), "type", "left_semi").join(stays.select("type"), "type", "left_anti"))


def activated(profiles: DataFrame, active: DataFrame, ids: DataFrame) -> DataFrame:
    """active with the profiles of ids(profile_id, ord) in the place of those of their types, the last of a type; unknown ones change nothing, other types stay."""
    new = profiles.select("profile_id", "type").join(ids, "profile_id").groupBy("type").agg(F.max_by("profile_id", "ord").alias("profile_id"))
    return active.join(new.select("type"), "type", "left_anti").select("type", "profile_id").unionByName(new)


# --- settings of chunking ----------------------------------------------------------------------------

#: Least values of sizes: what ``ChunkConfig.updated`` makes of a size that is too small.
LEAST = {n: getattr(ChunkConfig().updated(**{n: -1}), n) for n in ("fixed_size", "fixed_overlap", "parent_size", "child_size")}


def settings(config: ChunkConfig = ChunkConfig()) -> Column:
    """All parameters by name, as texts."""
    names = [f.name for f in fields(config)]
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.lit(str(getattr(config, n))) for n in names)))


def validated(changes: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """struct<settings,denied>: the parameters with the changes that are right, whole numbers held above their least values, and the names of those that are not: unknown ones, strategies that are none, numbers that are none."""
    known = {f.name: f.default for f in fields(config)}
    numbers = [n for n, d in known.items() if isinstance(d, int)]
    whole = lambda v: v.try_cast("long")
    number = lambda k, v: F.when(whole(v).isNotNull(), F.greatest(whole(v), F.element_at(_longs(LEAST), k))).cast("string")
    name = lambda v: F.when(v.isin([s for s, _ in STRATEGIES]), v)
    value = lambda k, v: F.when(k.isin(numbers), number(k, v)).when(k == "semantic_threshold", v.try_cast("double").cast("string")).when(k == "strategy", name(v))

    def made(right: Column, names: Column) -> Column:
        kept = F.map_filter(settings(config), lambda k, v: ~F.array_contains(names, k))
        return F.struct(F.map_concat(kept, right).alias("settings"), F.array_sort(F.array_except(F.map_keys(changes), names)).alias("denied"))

    # Each value once for a row, not once for each parameter.
    return let(F.map_filter(F.transform_values(changes, value), lambda k, v: v.isNotNull()), lambda right: let(F.map_keys(right), lambda names: made(right, names)))


def _longs(values: dict[str, int]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(F.lit(v).cast("long") for v in values.values())))


def scoped(base: Column, override: Column) -> Column:
    """The settings of one run: the override's values for names that the base has; the base is as it was for every other run."""
    given = F.coalesce(override, F.create_map().cast("map<string,string>"))

    def made(own: Column, base: Column) -> Column:
        return let(F.map_keys(own), lambda names: F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(names, k)), own))

    def of(base: Column) -> Column:
        return let(F.map_keys(base), lambda names: let(F.map_filter(given, lambda k, v: F.array_contains(names, k) & v.isNotNull()), lambda own: made(own, base)))

    return let(base, of)
