"""Host onboarding with the payment provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.functions.columns import empty_to_null, js_trim
from lendlane.operators.payouts import unique_hosts
from lendlane.operators.skew import lookup_join


def onboarding_eligibility(requests: DataFrame, hosts: DataFrame, config: DataFrame) -> DataFrame:
    """Onboarding requests with the first failing check, and the country it is about.

    The country is the request's, else the host's; an empty request country does not fall through.
    Requests are handled by ``request_id``: the first eligible one of a host without a country
    stores its own, and later requests without one use it.
    """
    known = unique_hosts(hosts, ["id", "country_code"]).select(
        "host_uid", F.col("id").alias("_host"), F.col("country_code").alias("_host_country")
    )
    nothing = F.lit(None).cast("string")
    alone = _judged(requests, known.withColumns({"_stored": nothing, "_stored_by": F.lit(None).cast("bigint")}), config)
    stores = (F.col("outcome") == "eligible") & empty_to_null("_host_country").isNull()
    stored = alone.where(stores).groupBy("host_uid").agg(
        F.min_by("onboarding_country", "request_id").alias("_stored"), F.min("request_id").cast("bigint").alias("_stored_by"))
    judged = _judged(requests, known.join(stored, "host_uid", "left"), config)
    return judged.select(
        *requests.columns,
        F.when(F.col("outcome").isin("blocked", "eligible"), F.col("onboarding_country")).alias("onboarding_country"),
        "outcome",
    )


def _judged(requests: DataFrame, known: DataFrame, config: DataFrame) -> DataFrame:
    """Each request against its host and what an earlier request of the host has stored."""
    lookup = config.select(
        F.col("country_code").alias("_code"), "country_status", "host_enabled", "stripe_connect_supported"
    )
    blocked = (
        (F.col("country_status") == "DISABLED")
        | (F.col("host_enabled") == F.lit(False))
        | (F.col("stripe_connect_supported") == F.lit(False))
    )
    outcome = (
        F.when(empty_to_null("host_uid").isNull(), "no_host_uid")
        .when(F.col("_host").isNull(), "host_not_found")
        .when(F.col("onboarding_country") == "", "no_country")
        .when(F.coalesce(blocked, F.lit(False)), "blocked")
        .otherwise("eligible")
    )
    stored = F.when(F.col("_stored_by") < F.col("request_id"), F.col("_stored"))
    country = F.upper(js_trim(F.coalesce("country", stored, "_host_country", F.lit(""))))
    return (
        lookup_join(requests, known, ["host_uid"], ["request_id"])
        .withColumn("onboarding_country", country)
        .join(lookup, F.col("onboarding_country") == F.col("_code"), "left")
        .withColumn("outcome", outcome)
    )


def onboarding_country_backfill(hosts: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Hosts without a country take the one of their first eligible request."""
    first = (
        eligibility.where(F.col("outcome") == "eligible").groupBy("host_uid")
        .agg(F.min_by("onboarding_country", "request_id").alias("_country"))
    )
    return hosts.join(first, "host_uid", "left").withColumn(
        "country_code",
        F.when(empty_to_null("country_code").isNull(), F.coalesce("_country", "country_code")).otherwise(F.col("country_code")),
    ).select(*hosts.columns)


def host_name_split(people: DataFrame, column: str = "full_name") -> DataFrame:
    """First word and the rest after the first space; NULL where there is none."""
    full = js_trim(F.coalesce(F.col(column), F.lit("")))
    space = F.instr(full, " ")
    return people.withColumns({
        "first_name": F.when(full != "", F.split_part(full, F.lit(" "), F.lit(1))),
        "last_name": F.when(space > 0, F.substring(full, space + 1, F.length(full))),
    })


def account_requests(eligibility: DataFrame, hosts: DataFrame) -> DataFrame:
    """The accounts to open: one per host without one, as its first eligible request asks.

    Name and phone fall back to the host's own where the request gives none; an empty one
    does not, and the e-mail never does.  Blank fields are NULL.
    """
    asked = [c for c in ("full_name", "email", "phone") if c in eligibility.columns]
    first = (
        eligibility.where(F.col("outcome") == "eligible").groupBy("host_uid")
        .agg(F.min_by(F.struct("request_id", "onboarding_country", *asked), "request_id").alias("_first"))
    )
    own = {"full_name": "full_name", "phone": "phone_number"}
    without = hosts.where(empty_to_null("stripe_account_id").isNull()).select(
        "host_uid", *[F.col(c).alias(f"_own_{f}") for f, c in own.items() if c in hosts.columns])

    def field(name: str) -> Column:
        given = [F.col(f"_first.{name}")] if name in asked else []
        fallback = [F.col(f"_own_{name}")] if own.get(name) in hosts.columns else []
        return empty_to_null(js_trim(F.coalesce(*given, *fallback, F.lit(""))))

    found = first.join(without, "host_uid").select(
        "host_uid", F.col("_first.request_id").alias("request_id"), F.col("_first.onboarding_country").alias("country"),
        field("email").alias("email"), field("full_name").alias("full_name"), field("phone").alias("phone"))
    return host_name_split(found).drop("full_name")


def link_accounts(hosts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Hosts with the ids of opened accounts (``host_uid, account_id``, one per host); a host that has one keeps it."""
    opened = accounts.select("host_uid", F.col("account_id").alias("_opened"))
    return hosts.join(opened, "host_uid", "left").withColumn(
        "stripe_account_id", F.coalesce(empty_to_null("stripe_account_id"), "_opened", "stripe_account_id")
    ).select(*hosts.columns)


def onboarding_state(accounts: DataFrame) -> DataFrame:
    """Per account snapshot: onboarding done, or a link needed for what is due."""
    due = (F.coalesce(F.size("currently_due"), F.lit(0)) > 0) | (F.coalesce(F.size("past_due"), F.lit(0)) > 0)
    enabled = F.coalesce("payouts_enabled", F.lit(False))
    done = enabled | (F.coalesce("details_submitted", F.lit(False)) & ~due)
    return accounts.select(
        "host_id", enabled.alias("payouts_enabled"), F.when(done, "done").otherwise("link_needed").alias("state")
    )


def hosts_with_payout_flag(hosts: DataFrame, states: DataFrame) -> DataFrame:
    """Hosts with the payout flag of their account; hosts without an account keep theirs."""
    flags = states.select(F.col("host_id").alias("id"), F.col("payouts_enabled").alias("_enabled"))
    return hosts.join(flags, "id", "left").withColumn(
        "payouts_enabled", F.coalesce("_enabled", "payouts_enabled")
    ).select(*hosts.columns)
