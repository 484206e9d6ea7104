"""Country configuration: defaults, upserts, layers and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.functions.columns import moment, touch

# Column defaults of a new country row.
COUNTRY_DEFAULTS = {
    "currency": "eur",
    "tax_mode": "NONE",
    "vat_rate": 0,
    "stripe_supported": True,
    "stripe_connect_supported": True,
    "stripe_tax_supported": False,
    "platform_fee_percent": 10,
    "payments_enabled": True,
    "payouts_enabled": True,
    "booking_enabled": True,
    "country_status": "ACTIVE",
    "market_status": "blocked",
    "client_enabled": True,
    "host_enabled": False,
    "stripe_mode": "none",
}

# Allowed values of the checked columns.
ALLOWED_VALUES = {
    "tax_mode": ["STRIPE_TAX", "MANUAL_RATE", "REVERSE_CHARGE", "NONE"],
    "country_status": ["ACTIVE", "WAITLIST", "DISABLED"],
    "market_status": ["live", "beta", "blocked"],
    "stripe_mode": ["direct", "preview", "extended", "none"],
}

# What the launch seed forces on every country it lists.
LAUNCH_SWITCHES = {
    "country_status": "ACTIVE",
    "booking_enabled": True,
    "payments_enabled": True,
    "payouts_enabled": True,
    "stripe_supported": True,
    "stripe_connect_supported": True,
}

# What opening all markets sets on every row.
OPEN_SWITCHES = {
    "market_status": "live",
    "country_status": "ACTIVE",
    "client_enabled": True,
    "host_enabled": True,
    "booking_enabled": True,
    "payments_enabled": True,
    "payouts_enabled": True,
    "stripe_supported": True,
    "stripe_connect_supported": True,
    "notes": "Global EUR live market. Auto payout enabled.",
}

# Columns a market list overwrites on conflict.
MARKET_COLUMNS = [
    "country_name", "currency", "market_status", "country_status", "client_enabled", "host_enabled",
    "booking_enabled", "payments_enabled", "payouts_enabled", "stripe_supported",
    "stripe_connect_supported", "stripe_mode", "notes",
]


def one_row_per_key(source: DataFrame, key: str) -> DataFrame:
    """``source``, failing at run time if a key occurs twice."""
    rest = [c for c in source.columns if c != key]
    grouped = source.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in rest]
    )
    message = F.concat(F.lit(f"two source rows for {key} "), F.col(key).cast("string"))
    checked = F.when(F.col("_n") > 1, F.raise_error(message).cast(source.schema[key].dataType)).otherwise(F.col(key))
    return grouped.withColumn(key, checked).select(*source.columns)


def upsert(
    target: DataFrame,
    source: DataFrame,
    key: str,
    update_cols: Sequence[str],
    as_of,
    defaults: dict | None = None,
    forced: dict | None = None,
) -> DataFrame:
    """Insert source rows with a new key; overwrite ``update_cols`` on known keys.

    Columns outside ``update_cols`` keep their old value.  New rows take source
    values, else ``defaults``, else NULL.  ``forced`` sets columns to constants on
    every row that is hit by an update.  Two source rows with one key are an error.
    """
    defaults, forced = defaults or {}, forced or {}
    src = one_row_per_key(source, key)
    src = src.select(F.col(key), F.lit(True).alias("_in_source"), *[F.col(c).alias(f"_s_{c}") for c in src.columns if c != key])
    dst = target.withColumn("_in_target", F.lit(True))
    joined = dst.join(src, key, "full_outer")
    known, hit = F.col("_in_target"), F.col("_in_source")

    def value(c: str) -> Column:
        kind = target.schema[c].dataType
        from_source = F.col(f"_s_{c}").cast(kind) if c in source.columns else None
        inserted = from_source if from_source is not None else F.lit(defaults.get(c)).cast(kind)
        if c == "updated_at" and from_source is None:
            inserted = moment(as_of, target)
        if c == "updated_at":
            updated = moment(as_of, target)
        elif c in forced:
            updated = F.lit(forced[c]).cast(kind)
        elif c in update_cols and from_source is not None:
            updated = from_source
        else:
            updated = F.col(c)
        return F.when(known & hit, updated).when(hit, inserted).otherwise(F.col(c))

    return joined.select(*[F.col(c) if c == key else value(c).alias(c) for c in target.columns])


def upsert_country(target: DataFrame, source: DataFrame, as_of, update_cols=None, forced=None) -> DataFrame:
    """Upsert by country code; new countries take the column defaults."""
    cols = update_cols if update_cols is not None else [c for c in MARKET_COLUMNS if c in source.columns]
    return upsert(target, source, "country_code", cols, as_of, COUNTRY_DEFAULTS, forced)


def upsert_partial(target: DataFrame, source: DataFrame, as_of, update_cols: Sequence[str] = ("android_url",)) -> DataFrame:
    """App-version upsert: only the store link changes on known apps."""
    return upsert(target, source, "app", update_cols, as_of)


def config_overlay(layers: Sequence[DataFrame], key: str = "country_code") -> DataFrame:
    """Ordered layers, the last one that has a column wins, per key and column.

    A layer sets exactly the columns it has, NULLs included.
    """
    columns = list(dict.fromkeys(c for layer in layers for c in layer.columns if c != key))
    stacked = None
    for number, layer in enumerate(layers):
        # a struct tells "set to NULL" from "not set"
        boxed = layer.select(
            F.col(key),
            F.lit(number).alias("_layer"),
            *[F.struct(F.col(c).alias("v")).alias(c) for c in layer.columns if c != key],
        )
        stacked = boxed if stacked is None else stacked.unionByName(boxed, allowMissingColumns=True)
    last = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_layer"))).getField("v").alias(c) for c in columns
    ]
    return stacked.groupBy(key).agg(*last)


def config_open_all(config: DataFrame, as_of) -> DataFrame:
    """Every switch on, every market live."""
    kept = {c: F.lit(v).cast(config.schema[c].dataType) for c, v in OPEN_SWITCHES.items() if c in config.columns}
    added = {c: F.lit(v) for c, v in OPEN_SWITCHES.items() if c not in config.columns}
    return config.withColumns({**kept, **added, "updated_at": moment(as_of, config)})


def generated_mirrors(config: DataFrame) -> DataFrame:
    """Mirror columns under their second names, computed at read time."""
    return config.withColumns({
        "payment_enabled": F.col("payments_enabled"),
        "payout_enabled": F.col("payouts_enabled"),
        "default_currency": F.col("currency"),
    })


def touch_updated_at(old: DataFrame, new: DataFrame, key: str, as_of) -> DataFrame:
    """``new`` with ``updated_at = as_of`` on rows that differ from ``old``."""
    watched = [c for c in new.columns if c not in (key, "updated_at") and c in old.columns]
    before = old.select(key, F.struct(*watched).alias("_before"), F.lit(True).alias("_known"))
    joined = new.join(before, key, "left")
    changed = F.coalesce(F.col("_known"), F.lit(False)) & ~F.col("_before").eqNullSafe(F.struct(*watched))
    return joined.withColumn("updated_at", touch(new, changed, as_of)).select(
        *new.columns, *([] if "updated_at" in new.columns else ["updated_at"])
    )


def config_constraint_audit(config: DataFrame, key: str = "country_code") -> DataFrame:
    """One row per value outside its allowed list.  NULL passes, as in a SQL CHECK."""
    violations = [
        F.when(~F.col(c).isin(allowed), F.struct(F.lit(c).alias("constraint_column"), F.col(c).alias("bad_value")))
        for c, allowed in ALLOWED_VALUES.items()
        if c in config.columns
    ]
    return (
        config.select(key, F.explode(F.filter(F.array(*violations), lambda v: v.isNotNull())).alias("v"))
        .select(key, "v.constraint_column", "v.bad_value")
    )
