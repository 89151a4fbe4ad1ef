"""Device registry, access control and dashboard figures (REG, ACL, DSH)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def live(devices: DataFrame) -> DataFrame:
    return devices.where("deleted_at is null")


def filtered(devices: DataFrame, region: str | None = None, customer: str | None = None, firmware_version: str | None = None) -> DataFrame:
    """REG-1: live devices that equal the given values; an empty value is no filter."""
    out = live(devices)
    for column, value in (("region", region), ("customer", customer), ("firmware_version", firmware_version)):
        if value:
            out = out.where(F.col(column) == value)
    return out


DEVICE_ORDER = [F.desc_nulls_last, F.asc_nulls_first, F.asc_nulls_first]


def device_page(devices: DataFrame, page: int | None = 1, limit: int | None = 20, **filters) -> DataFrame:
    """REG-1: one page, newest first, then by region and customer (and id, for a total order)."""
    page, limit = page or 1, limit or 20
    order = [f(c) for f, c in zip(DEVICE_ORDER, ("last_updated_at", "region", "customer"))]
    return filtered(devices, **filters).orderBy(*order, "device_id").offset((page - 1) * limit).limit(limit)


def page_facts(devices: DataFrame, page: int | None = 1, limit: int | None = 20, **filters) -> DataFrame:
    """REG-2: (total, page, limit, pages)."""
    page, limit = page or 1, limit or 20
    return filtered(devices, **filters).agg(F.count("*").alias("total")).select("total", F.lit(page).alias("page"), F.lit(limit).alias("limit"), F.ceil(F.col("total") / limit).alias("pages"))


def numbered_pages(rows: DataFrame, order: list, limit: int, by: list[str]) -> DataFrame:
    """DSH-4: rows with their page, place and "a-b of n" within each group, all pages at once."""
    w = Window.partitionBy(*by)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(*order))
    page = F.floor((i - 1) / limit) + 1
    shown = F.concat(((page - 1) * limit + 1).cast("string"), F.lit("-"), F.least(page * limit, n).cast("string"), F.lit(" of "), n.cast("string"))
    return rows.withColumns({"page": page, "place": i, "shown": shown})


def by_ids(devices: DataFrame, ids: DataFrame) -> DataFrame:
    """REG-3: live devices with one of the ids."""
    return live(devices).join(ids.select("device_id").distinct(), "device_id", "left_semi")


def inserted(devices: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """REG-4: devices with the valid rows of new (region and customer given), and the rejected rows."""
    ok = (F.coalesce("region", F.lit("")) != "") & (F.coalesce("customer", F.lit("")) != "")
    good = new.where(ok)
    if "device_id" not in good.columns:
        good = good.withColumn("device_id", F.expr("uuid()"))
    return devices.unionByName(good, allowMissingColumns=True), new.where(~ok)


def updated(devices: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """REG-5: live devices take the fields that their update gives (not null there) and a new time; others stay.

    updates: (device_id, given array<string> of field names, fields). A field named in ``given`` is set even to null.
    """
    fields = [c for c in updates.columns if c not in ("device_id", "given")]
    u = updates.select("device_id", F.col("given").alias("_given"), *[F.col(c).alias(f"_{c}") for c in fields])
    hit = F.col("deleted_at").isNull() & (F.size("_given") > 0)
    out = devices.join(u, "device_id", "left")
    new = {c: F.when(hit & F.array_contains("_given", c), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    return out.withColumns(new | {"last_updated_at": F.when(hit, now).otherwise(F.col("last_updated_at"))}).select(*devices.columns)


def _marked(devices: DataFrame, ids: DataFrame) -> DataFrame:
    return devices.join(ids.select("device_id").distinct().withColumn("_hit", F.lit(True)), "device_id", "left")


def soft_deleted(devices: DataFrame, ids: DataFrame, now: Column, who: Column) -> DataFrame:
    """REG-6: live devices with one of the ids are deleted now; ``affected`` tells which."""
    hit = F.coalesce("_hit", F.lit(False)) & F.col("deleted_at").isNull()
    return _marked(devices, ids).withColumn("affected", hit).withColumns({"deleted_at": F.when(F.col("affected"), now).otherwise(F.col("deleted_at")), "deleted_by": F.when(F.col("affected"), who).otherwise(F.col("deleted_by"))}).drop("_hit")


def restored(devices: DataFrame, ids: DataFrame) -> DataFrame:
    """REG-7: deleted devices with one of the ids are live again; ``affected`` tells which."""
    hit = F.coalesce("_hit", F.lit(False)) & F.col("deleted_at").isNotNull()
    none = F.lit(None)
    return _marked(devices, ids).withColumn("affected", hit).withColumns({"deleted_at": F.when(~F.col("affected"), F.col("deleted_at")).otherwise(none), "deleted_by": F.when(~F.col("affected"), F.col("deleted_by")).otherwise(none)}).drop("_hit")


def configurations_in_sets(sets: DataFrame, items: DataFrame, configurations: DataFrame) -> DataFrame:
    """REG-9: (set_id, position, configuration_id, name) of all sets; order by position within a set."""
    return sets.select("set_id").join(items, "set_id").join(configurations, "configuration_id").select("set_id", "position", "configuration_id", "name")


def sets_with_configuration(sets: DataFrame, items: DataFrame, keys: DataFrame) -> DataFrame:
    """REG-10: (configuration_id, set_id, set_name) for each key."""
    return items.join(keys.select("configuration_id").distinct(), "configuration_id").join(sets, "set_id").select("configuration_id", "set_id", "set_name").distinct()


def orders_with_users(orders: DataFrame, users: DataFrame) -> DataFrame:
    """REG-11: orders beside their users; the caller sorts newest first."""
    return orders.join(users, "user_id")


def effective_permissions(user_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """ACL-1: (user_id, permission), the union over a user's groups; groups without permissions count for nothing."""
    return user_roles.select("user_id", "role").distinct().join(role_permissions.select("role", "permission").distinct(), "role").select("user_id", "permission").distinct()


def users_with_any_role(user_roles: DataFrame, roles: list[str]) -> DataFrame:
    """ACL-2: users with one of the roles."""
    return user_roles.where(F.col("role").isin(roles)).select("user_id").distinct()


def firmware_facts(firmware: DataFrame, by: list[str]) -> DataFrame:
    """DSH-1: total, stable, distinct hardware over arrays, and the newest stable version or N/A, for each group."""
    stable = F.col("status") == "stable"
    own = firmware.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(stable).alias("stable"), F.coalesce(F.max_by(F.when(stable, F.col("version")), F.when(stable, F.struct("released_at", "version"))), F.lit("N/A")).alias("latest_stable"))
    kinds = firmware.select(*by, F.explode("hardware").alias("h")).groupBy(*by).agg(F.countDistinct("h").alias("hardware"))
    return own.join(kinds, by, "left").withColumn("hardware", F.coalesce("hardware", F.lit(0).cast("long")))


def open_issues(issues: DataFrame, by: list[str]) -> DataFrame:
    """DSH-2: (by, severity, n, total) of open issues; severities without any do not appear."""
    own = issues.where(F.col("status") == "open")
    counts = own.groupBy(*by, "severity").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(*by)))


def review_lists(reviews: DataFrame, by: list[str], order: list) -> DataFrame:
    """DSH-3: for each group the completed reviews and the first one in progress."""
    rank = F.row_number().over(Window.partitionBy(*by, "status").orderBy(*order))
    return reviews.withColumn("_rank", rank).where((F.col("status") == "completed") | ((F.col("status") == "in_progress") & (F.col("_rank") == 1))).drop("_rank")
