"""Operators over many tenants at once, whose ids may be equal.

An operator that groups and joins by ids is run on ids that carry their tenant, and its result has the tenant as a column again.
Nothing of one tenant can meet anything of another then, whatever the operator does inside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts a tenant from an id.
MARK = "\x1f"


def carried(rows: DataFrame, tenant: str, ids: tuple[str, ...]) -> DataFrame:
    """``rows`` with the tenant in front of each id; a null id stays null."""
    return rows.withColumns({i: F.concat(F.col(tenant), F.lit(MARK), F.col(i).cast("string")) for i in ids if i in rows.columns})


def in_tenants(run: Callable[..., DataFrame], tenant: str, ids: tuple[str, ...], *tables: DataFrame, inside: bool = False) -> DataFrame:
    """``run`` on tables that all have the tenant's column, by tenant; the result has the tenant and the ids as they were.

    ``ids`` are the columns that tell rows apart within a tenant. The first of them must be in the result. ``run`` sees the
    tenant's own column only if it counts by it (``inside``).
    """
    kinds = {i: t.schema[i].dataType for t in reversed(tables) for i in ids if i in t.columns}
    own_ids = [carried(t, tenant, ids) for t in tables]
    out = run(*(own_ids if inside else [t.drop(tenant) for t in own_ids]))
    own = F.substring_index(ids[0], MARK, 1)
    bare = {i: F.substring_index(i, MARK, -1).cast(kinds[i]) for i in ids if i in out.columns}
    return out.withColumn(tenant, own).withColumns(bare)


def of_tenants(rows: DataFrame, asked: DataFrame, tenant: str) -> DataFrame:
    """The rows of the tenants that ``asked`` names; a table that is partitioned by tenant is read for those alone."""
    return rows.join(F.broadcast(asked.select(tenant).distinct()), tenant, "left_semi")
