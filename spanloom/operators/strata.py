"""What is said of a generated item: its strata, whether it was constructed to hold, and what an adapter must offer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roles of an organisation that are on the client's side; the limits that an adapter must report.
CLIENT_SIDE = ("client", "prospect", "counterparty", "nda-party")
ADAPTER_FLOOR = {
    "maxComputeWorkgroupStorageSize": 32768,
    "maxStorageBuffersPerShaderStage": 10,
    "maxBufferSize": 268435456,
    "maxStorageBufferBindingSize": 134217728,
}


def role_class(role: Column) -> Column:
    return F.when(role.isin(*CLIENT_SIDE), "client-side").otherwise("non-client")


def constructed_from(roles: Column) -> Column:
    """Sorted roles of an item's injections, without those that have none."""
    return F.sort_array(F.filter(roles, lambda r: r.isNotNull() & (r != "none")))


def constructed(roles: Column) -> Column:
    """Whether an item was built so that the predicate holds: one role on the client's side is enough."""
    return F.exists(constructed_from(roles), lambda r: r.isin(*CLIENT_SIDE))


def wave(item_id: Column) -> Column:
    """The wave that an item's id names; negatives are pristine."""
    return F.when(item_id.startswith("neg-"), "pristine").otherwise(F.substring_index(item_id, "-", -1))


def strata(item_id: Column, meta: Column, roles: Column) -> list[Column]:
    """The stratum of an item in every dimension. meta: map of text; an ordinary carrier says nothing of its stratum."""
    said = lambda k: F.try_element_at(meta, F.lit(k))
    return [
        said("carrierId").alias("carrier"),
        F.coalesce(said("carrierStratum"), F.lit("ordinary")).alias("carrier_stratum"),
        wave(item_id).alias("wave"),
        said("density").alias("density"),
        said("carrierRegister").alias("register"),
        constructed(roles).cast("string").alias("constructed_prediction"),
    ]


def meets_floor(limits: Column, floor: dict[str, int] = ADAPTER_FLOOR) -> Column:
    """Whether an adapter reports every limit, each at its floor at least. limits: map of numbers."""
    ok = F.lit(True)
    for name, least in floor.items():
        ok = ok & F.coalesce(F.try_element_at(limits, F.lit(name)) >= least, F.lit(False))
    return ok
