"""Sources of metadata in JSON and key-value form: engine objects, package locks and power supplies."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_OBJECTS = 128
IMAGES = "array<struct<Id:string,RepoTags:array<string>,Created:bigint,Size:bigint>>"


def engine_images(responses: DataFrame, most: int | None = MAX_OBJECTS) -> DataFrame:
    """Ids, tags and dates of an engine's images from its response bodies (context, body); of a body more than ``most`` are cut and marked, none without it."""
    parsed = responses.withColumn("images", F.from_json("body", IMAGES, {"mode": "FAILFAST"}))
    many, told = (F.lit(False), F.col("images")) if most is None else (F.size("images") > most, F.slice("images", 1, most))
    rows = parsed.select("context", many.alias("truncated"), F.explode(told).alias("i"))
    return rows.select("context", F.col("i.Id").alias("id"), F.concat_ws(",", F.array_sort(F.coalesce("i.RepoTags", F.array().cast("array<string>")))).alias("tags"), F.col("i.Created").alias("created"), "truncated")


CONTAINERS = "array<struct<Id:string,Image:string,State:string,Created:bigint>>"
#: States that an engine's container may have (fixed values).
STATES = ("created", "running", "paused", "restarting", "removing", "exited", "dead")


def engine_containers(responses: DataFrame) -> DataFrame:
    """Ids, images, states and dates of an engine's containers from its response bodies (context, body); more than 128 are cut and marked."""
    parsed = responses.withColumn("_c", F.from_json("body", CONTAINERS, {"mode": "FAILFAST"}))
    rows = parsed.select("context", (F.size("_c") > MAX_OBJECTS).alias("truncated"), F.explode(F.slice("_c", 1, MAX_OBJECTS)).alias("c"))
    state = F.when(F.col("c.State").isin(*STATES), F.col("c.State")).otherwise("unknown")
    return rows.select("context", F.col("c.Id").alias("id"), F.col("c.Image").alias("image"), state.alias("state"), F.col("c.Created").alias("created"), "truncated")


CACHE = "struct<BuildCache:array<struct<ID:string,Type:string,InUse:boolean,Shared:boolean,UsageCount:bigint>>>"
#: Kinds of records that an engine's build cache may list (fixed values).
CACHE_TYPES = ("internal", "frontend", "source.local", "source.git.checkout", "exec.cachemount", "regular")


def engine_cache(responses: DataFrame) -> DataFrame:
    """Records of an engine's build cache from its response bodies (context, body); flags it does not tell stay null.

    A body without the list, with a record of no id, an unknown type or a negative count, or with an
    id twice is ``malformed``; one of more than 128 records is ``out_of_bounds``. Such a context is one
    row without a record, as is one whose cache is ``empty``.
    """
    parsed = responses.withColumn("_r", F.from_json("body", CACHE)["BuildCache"])
    odd = F.exists("_r", lambda r: F.coalesce(r["ID"], F.lit("")).isin("") | (F.length(r["ID"]) > 128) | ~F.coalesce(r["Type"].isin(*CACHE_TYPES), F.lit(False)) | F.coalesce(r["UsageCount"] < 0, F.lit(False)))
    twice = F.size(F.array_distinct(F.transform("_r", lambda r: r["ID"]))) < F.size("_r")
    status = F.when(F.col("_r").isNull(), "malformed").when(F.size("_r") > MAX_OBJECTS, "out_of_bounds").when(odd | twice, "malformed").when(F.size("_r") == 0, "empty").otherwise("observed")
    rows = parsed.withColumn("status", status).select("context", "status", F.explode_outer(F.when(F.col("status") == "observed", F.col("_r"))).alias("r"))
    return rows.select("context", "status", F.col("r.ID").alias("id"), F.col("r.Type").alias("type"), F.col("r.InUse").alias("in_use"), F.col("r.Shared").alias("shared"), F.col("r.UsageCount").alias("usage_count"))


def strict_object(text: str, depth: int = 64, values: int = 50_000) -> dict:
    """A JSON object without repeated keys and within bounds."""
    seen = 0

    def pairs(found: list[tuple[str, object]]) -> dict:
        nonlocal seen
        seen += len(found)
        out = dict(found)
        if len(out) != len(found) or seen > values:
            raise ValueError("repeated key or too many values")
        return out

    def level(x, left: int) -> None:
        if left < 0:
            raise ValueError("too deep")
        for child in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            level(child, left - 1)

    value = json.loads(text, object_pairs_hook=pairs)
    if not isinstance(value, dict):
        raise ValueError("not an object")
    level(value, depth)
    return value


PACKAGE_PATH = re.compile(r"(?:.*/)?node_modules/((?:@[^/]+/)?[^/@.][^/]*)")


def _lock_layout(manifest: str, lock: str) -> tuple:
    """Package directories of a lockfile that fits its manifest, in order; otherwise why it does not."""
    try:
        m, found = strict_object(manifest), strict_object(lock)
    except (ValueError, TypeError):
        return ("malformed", None, None)
    if found.get("lockfileVersion") not in (2, 3):
        return ("unsupported_version", None, None)
    packages = found.get("packages") or {}
    root = packages.get("", {})
    groups = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
    if any((m.get(g) or {}) != (root.get(g) or {}) for g in groups):
        return ("manifest_differs", found["lockfileVersion"], None)
    paths = sorted(p for p in packages if p)
    if not all(PACKAGE_PATH.fullmatch(p) for p in paths):
        return ("unsupported_path", found["lockfileVersion"], None)
    return ("supported", found["lockfileVersion"], paths)


def lock_layout(manifest: str, lock: str) -> Column:
    """Status, version and package directories of the lockfiles in one column against the manifests in another."""
    return F.udf(_lock_layout, "struct<status:string,version:int,packages:array<string>>")(manifest, lock)


#: Types of supplies that are not batteries (fixed values).
EXTERNAL = ("Mains", "USB", "USB_DCP", "USB_CDP", "USB_ACA", "USB_C", "USB_PD", "USB_PD_DRP", "BrickID", "Wireless")


def supply_class(scope: Column, type_: Column, online: Column, present: Column, status: Column) -> Column:
    """What one supply's attributes say: nothing of the system, a battery or one that is discharging, or why it is ambiguous. A missing attribute is null and never assumed."""
    battery = (
        F.when(~F.coalesce(present.isin("0", "1"), F.lit(False)), "battery_presence_unconfirmed")
        .when(present == "0", "absent")
        .when(status == "Discharging", "discharging")
        .when(status.isin("Charging", "Not charging", "Full"), "battery")
        .otherwise("battery_status_unconfirmed")
    )
    external = F.when(~type_.isin(*EXTERNAL), "supply_type_outside_profile").when(F.coalesce(online.isin("0", "1", "2"), F.lit(False)), "external").otherwise("external_supply_unconfirmed")
    return (
        F.when(scope == "Device", "outside")
        .when(~scope.eqNullSafe(F.lit("System")), "system_scope_unconfirmed")
        .when(type_.isNull(), "supply_type_unconfirmed")
        .when(type_ == "Battery", battery)
        .otherwise(external)
    )


def power_state(supplies: DataFrame) -> DataFrame:
    """Whether a discharging system battery was seen on each host among its supplies (host, name, scope, type, online, present, status).

    That none was seen says nothing: the state then is unknown, with the first ambiguous supply's reason by name.
    """
    rows = supplies.withColumn("_c", supply_class(*[F.col(c) for c in ("scope", "type", "online", "present", "status")]))
    odd = ~F.col("_c").isin("outside", "absent", "external", "battery", "discharging")
    found = rows.groupBy("host").agg(
        F.count_if(F.col("_c").isin("battery", "discharging")).alias("confirmed_batteries"), F.count_if(F.col("_c") == "discharging").alias("discharging_batteries"), F.count_if(odd).alias("ambiguous"),
        F.min(F.when(odd, F.struct("name", "_c"))).getField("_c").alias("_why"),
    )
    seen = F.col("discharging_batteries") > 0
    reason = F.when(seen, "confirmed_system_battery_discharge_witness").otherwise(F.coalesce("_why", F.lit("no_system_battery_discharge_witness")))
    return found.select("host", F.when(seen, "system_battery_discharging_observed").otherwise("unknown").alias("status"), reason.alias("reason"), "confirmed_batteries", "discharging_batteries", "ambiguous")


def envelope(rows: DataFrame, command: str) -> Column:
    """One versioned JSON document for each row of a report."""
    return F.to_json(F.struct(F.lit(1).alias("api_version"), F.lit(True).alias("ok"), F.lit(command).alias("command"), F.struct(*rows.columns).alias("result")))
