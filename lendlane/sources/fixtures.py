"""Marketplace-shaped views over the driver's star-schema tables.

Each view is one SQL text, used for Spark and, with the tokens replaced, for
the DuckDB oracle.  Decimals are multiplied, never divided: the two engines
type a division differently.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

AS_OF = "1998-06-15 00:00:00"

DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# @TS: a timestamp literal without time zone.  @FOUR: one row for each k in 0..3.
# @PARTS, @SUPPLIERS: rows of these tables; for Spark the number itself.
COUNTED = {"@PARTS": "part", "@SUPPLIERS": "supplier", "@ORDERS": "orders"}
SPARK_TOKENS = {"@TS": "timestamp_ntz", "@FOUR": "lateral view explode(array(0, 1, 2, 3)) g as k",
    "@THREE": "lateral view explode(array(0, 1, 2)) g as k"}
ORACLE_TOKENS = {
    "@TS": "timestamp", "@FOUR": "cross join range(4) as g(k)", "@THREE": "cross join range(3) as g(k)",
    **{token: f"(select count(*) from {table})" for token, table in COUNTED.items()},
}

# several events per booking, all bookings at every scale, and one booking with a third of the events
_EVENT_BOOKING = "(case when event_id % 3 = 1 then 4 else 1 + (cast((event_id - event_id % 4) / 4 as bigint)*7919) % @ORDERS end)"

_PROFILE_RATES = """
 cast((p_partkey*(k+1)) % 8 as decimal(10,2)) as short_rental_price,
 cast((p_partkey+k) % 15 as decimal(10,2)) as daily_rate,
 cast((p_partkey*3+k) % 70 as decimal(10,2)) as weekly_rate,
 case when (p_partkey+k) % 4 = 0 then null else cast((p_partkey*5+k) % 200 as decimal(10,2)) end as monthly_rate,
 case when k=3 then null else @TS '1998-01-01 00:00:00' end as updated_at"""

_PROFILE_HEAD = """
 select cast(p_partkey*4+k as bigint) as id, {listing} as trailer_id, p_partkey % 97 as host_id,
 case when k=1 then 'Default' else concat('P', cast(k as varchar(2))) end as name,
 case (p_partkey+k) % 5 when 0 then null when 1 then false else true end as is_active,
 case (p_partkey+k) % 6 when 0 then null when 1 then 'USD' else 'EUR' end as currency,"""

VIEWS = {
    "country_config": """
 select concat('N', chr(65+n_nationkey)) as country_code, n_name as country_name,
 case n_nationkey % 4 when 0 then 'eur' when 1 then 'usd' when 2 then 'jpy' else 'sek' end as currency,
 case n_nationkey % 5 when 0 then 'NONE' when 1 then 'STRIPE_TAX' when 2 then 'manual' when 3 then null else 'MANUAL_RATE' end as tax_mode,
 cast(0 as decimal(5,2)) as vat_rate, cast(10 as decimal(5,2)) as platform_fee_percent,
 case n_nationkey % 6 when 5 then 'DISABLED' when 4 then 'WAITLIST' else 'ACTIVE' end as country_status,
 case n_nationkey % 6 when 5 then 'blocked' when 4 then 'beta' else 'live' end as market_status,
 case n_nationkey % 4 when 0 then 'direct' when 1 then 'preview' when 2 then 'other' else 'none' end as stripe_mode,
 n_nationkey % 7 <> 3 as booking_enabled, n_nationkey % 8 <> 2 as payments_enabled, n_nationkey % 4 <> 1 as payouts_enabled,
 n_nationkey % 10 <> 7 as stripe_supported, n_nationkey % 3 <> 2 as stripe_connect_supported,
 n_nationkey % 2 = 1 as stripe_tax_supported, true as client_enabled, n_nationkey % 5 <> 4 as host_enabled,
 cast(null as varchar(10)) as notes, cast(null as varchar(10)) as invoice_legal_note, cast(null as varchar(10)) as legal_entity,
 @TS '1998-01-01 00:00:00' as updated_at
 from {nation} where n_nationkey % 9 <> 8""",
    "country_source": """
 select concat('N', chr(65+n_nationkey)) as country_code, concat('New ', n_name) as country_name,
 'eur' as currency, 'live' as market_status, 'ACTIVE' as country_status, n_nationkey % 2 = 0 as payouts_enabled
 from {nation} where n_nationkey % 3 <> 1""",
    "layer_status": """
 select concat('N', chr(65+n_nationkey)) as country_code, 'eur' as currency,
 case when n_nationkey % 4 = 0 then null else 'second layer' end as notes
 from {nation} where n_nationkey % 3 = 0""",
    "layer_payout": """
 select concat('N', chr(65+n_nationkey)) as country_code, false as payouts_enabled, 'gbp' as currency
 from {nation} where n_nationkey % 5 = 0""",
    "hosts": """
 select s_suppkey as id, concat('host_', cast(s_suppkey as varchar(20))) as host_uid, s_name as full_name,
 case s_suppkey % 4 when 0 then null when 1 then concat(' Info', cast(s_suppkey as varchar(20)), '@Mail.example ')
  else concat('host', cast(s_suppkey as varchar(20)), '@mail.example') end as email,
 case s_suppkey % 10 when 0 then null when 1 then '' when 2 then ' na ' else lower(concat('N', chr(65+s_nationkey))) end as country_code,
 case when s_suppkey % 7 = 0 then null else concat('acct_', cast(s_suppkey as varchar(20))) end as stripe_account_id,
 s_acctbal > 0 as payouts_enabled from {supplier}""",
    "trailers": """
 select p_partkey as id, p_partkey % @SUPPLIERS as host_id,
 concat('host_', cast(p_partkey % @SUPPLIERS as varchar(20))) as host_uid, p_name as trailername,
 p_brand as model, p_type as main_category, p_size*50 as capacity_kg,
 case when p_partkey % 3 = 0 then concat('District ', cast(p_partkey % 7 as varchar(20)), ', City ', cast(p_partkey % 13 as varchar(20)))
  else concat('City ', cast(p_partkey % 13 as varchar(20))) end as location_name,
 case when p_partkey % 19 = 0 then null
  else cast(cast((p_partkey*7919) % 1800000 as decimal(9,0))*cast(0.0001 as decimal(5,4)) - 90 as decimal(10,6)) end as latitude,
 cast(cast((p_partkey*104729) % 3600000 as decimal(9,0))*cast(0.0001 as decimal(5,4)) - 180 as decimal(10,6)) as longitude,
 case p_partkey % 10 when 9 then 'inactive' when 8 then 'ACTIVE' when 7 then null else 'active' end as status,
 case when p_partkey % 17 = 0 then null else p_partkey % 4 <> 3 end as is_available,
 case when p_partkey % 23 = 0 then null else p_partkey % 6 = 3 end as busy_display,
 cast(p_size % 9 as decimal(10,2)) as price_per_hr, case when p_partkey % 5 = 0 then null else 'EUR' end as currency,
 case when p_partkey % 4 = 0 then 'Start listing.' else 'Other.' end as description,
 case p_partkey % 3 when 0 then null when 1 then '["a"]' else '["a","b","c"]' end as photos,
 case when p_partkey % 6 = 3 then @TS '1998-06-01 00:00:00' + cast(p_partkey % 30 as int) * interval '1' day end as starter_expires_at
 from {part}""",
    "pricing_profiles": _PROFILE_HEAD.replace("{listing}", "p_partkey")
    + _PROFILE_RATES + "\n from {part} @FOUR where p_partkey % 11 <> 5",
    # with an hourly rate, rows without a listing, and listings without any price
    "sparse_profiles": _PROFILE_HEAD.replace("{listing}", "case when p_partkey % 31 = 0 then null else p_partkey end")
    + """
 case when p_partkey % 7 = 2 then null else cast((p_partkey*7+k) % 9 as decimal(10,2)) end as hourly_rate,
 case when p_partkey % 7 = 2 then null else cast((p_partkey*(k+1)) % 8 as decimal(10,2)) end as short_rental_price,
 case when p_partkey % 7 = 2 then cast(0 as decimal(10,2)) else cast((p_partkey+k) % 15 as decimal(10,2)) end as daily_rate,
 case when p_partkey % 7 = 2 then null else cast((p_partkey*3+k) % 70 as decimal(10,2)) end as weekly_rate,
 case when p_partkey % 7 = 2 or (p_partkey+k) % 4 = 0 then null else cast((p_partkey*5+k) % 200 as decimal(10,2)) end as monthly_rate,
 case when k=3 then null else @TS '1998-01-01 00:00:00' end as updated_at
 from {part} @FOUR where p_partkey % 11 <> 5""",
    "bookings": """
 select o_orderkey+1 as id, (o_orderkey*7) % @PARTS as trailer_id,
 case when o_orderkey % 43 = 0 then null when o_orderkey % 47 = 0 then 'host_gone'
  else concat('host_', cast(((o_orderkey*7) % @PARTS) % @SUPPLIERS as varchar(20))) end as host_uid,
 case o_orderkey % 5 when 0 then null when 1 then '' else 'Box' end as trailer_type,
 case o_orderstatus when 'F' then 'completed' when 'O' then 'Paid_Confirmed'
  else case when o_orderkey % 2 = 0 then 'in_progress' else null end end as status,
 case when o_orderkey % 3 = 0 then 'paid' when o_orderkey % 3 = 1 then 'pending' else null end as payment_status,
 case when o_orderkey % 51 = 0 then null when o_orderkey % 17 = 0 then cast(0.3 as decimal(16,5))
  when o_orderkey % 4 = 0 then cast(cast(o_totalprice as decimal(12,2))*cast(0.1 as decimal(4,3)) as decimal(16,5))
  else cast(cast(o_totalprice as decimal(12,2))*cast(0.001 as decimal(4,3)) as decimal(16,5)) end as total_price,
 case when o_orderkey % 13 = 0 then 'usd' when o_orderkey % 13 = 1 then null else 'eur' end as currency,
 o_orderdate as start_at, o_orderdate + cast(1 + o_orderkey % 30 as int) * interval '1' day as end_at,
 case o_orderkey % 4 when 0 then 'paid' when 1 then 'failed' else 'pending' end as payout_status,
 case when o_orderkey % 21 = 0 then null
  else cast(cast(o_totalprice as decimal(12,2))*cast(0.001 as decimal(4,3)) as decimal(16,5)) end as host_payout_amount,
 o_orderdate + interval '2' day as payout_due_at,
 case when o_orderkey % 2 = 0 then concat('cs_', cast(o_orderkey+1 as varchar(20))) end as stripe_checkout_session_id
 from {orders}""",
    "payment_events": """
 select event_id, ts,
 case event_type when 'purchase' then 'checkout.session.completed' when 'click' then 'checkout.session.async_payment_succeeded'
  when 'error' then 'checkout.session.async_payment_failed' else 'other' end as type,
 case when event_id % 29 = 0 then null when event_id % 31 = 0 then 'abc' when event_id % 37 = 0 then '99999999'
  else cast(@BOOKING as varchar(20)) end as booking_id,
 case when event_id % 5 = 0 then 'unpaid' else 'paid' end as payment_status,
 concat('cs_', cast(case when event_id % 7 = 0 then 0 else @BOOKING end as varchar(20))) as session_id,
 case event_id % 3 when 0 then concat('pi_', cast(event_id as varchar(20)))
  when 1 then concat('{{"id":"pi_', cast(event_id as varchar(20)), '"}}') end as payment_intent
 from {events} @THREE where k = 0 or event_id % 41 = 0""".replace("@BOOKING", _EVENT_BOOKING),
    "city_centres": """
 select concat('City ', cast(n_nationkey as varchar(20))) as loc,
 cast(cast(n_nationkey as decimal(9,4))*cast(3.5 as decimal(5,4)) as decimal(10,6)) as clat,
 cast(cast(n_nationkey as decimal(9,4))*cast(-2.25 as decimal(5,4)) as decimal(10,6)) as clng
 from {nation} where n_nationkey % 6 <> 5""",
    "city_offsets": """
 select cast(i as bigint) as i, cast(dlat as decimal(10,6)) as dlat, cast(dlng as decimal(10,6)) as dlng
 from (values (0,0.0060,0.0040),(1,-0.0040,0.0080),(2,0.0080,-0.0040),(3,-0.0060,-0.0060),(4,0.0100,0.0030),(5,0.0030,-0.0090))
 as o(i,dlat,dlng)""",
    "listing_batch": """
 select p_partkey as seq, p_partkey % @SUPPLIERS as host_id, p_name as trailername, p_brand as model,
 case when p_partkey % 2 = 0 then concat('City ', cast(p_partkey % 13 as varchar(20)))
  when p_partkey % 41 = 0 then null
  else concat('New ', cast(p_partkey % 50 as varchar(20))) end as location_name,
 concat('https://photos.example/', cast(p_partkey % 9 as varchar(20)), '.jpg') as photo from {part}""",
    # whole listings to load: some there already, some twice in the batch, some without a place
    "listing_rows": """
 select p_partkey*2+k as seq, p_name as trailername, p_brand as model, p_type as trailer_type, p_type as main_category,
 concat('sub ', cast(p_size as varchar(9))) as subtype, concat('Listing ', cast(p_partkey as varchar(20))) as description,
 cast(p_size*50 as int) as capacity_kg, concat(cast(p_size as varchar(9)), ' x 1.3') as dimensions_m,
 cast(1 + p_partkey % 2 as varchar(9)) as axles, case when p_partkey % 4 = 0 then null else 'grey' end as color,
 concat('https://photos.example/', cast(p_partkey % 9 as varchar(20)), '.jpg') as photo,
 cast(cast(p_partkey % 900000 as decimal(9,0))*cast(0.0001 as decimal(5,4)) as decimal(10,6)) as latitude,
 cast(cast(p_partkey % 1800000 as decimal(9,0))*cast(-0.0001 as decimal(5,4)) as decimal(10,6)) as longitude,
 case when p_partkey % 3 = 0 then concat('District ', cast(p_partkey % 7 as varchar(20)), ', City ', cast(p_partkey % 13 as varchar(20)))
  when p_partkey % 41 = 0 then null when p_partkey % 2 = 0 then concat('City ', cast(p_partkey % 13 as varchar(20)))
  else concat('New ', cast(p_partkey % 50 as varchar(20))) end as location_name
 from {part} @THREE where k = 0 or (k = 1 and p_partkey % 10 = 3)""",
    "checkout_requests": """
 select event_id, case when event_id % 23 = 0 then '-1' when event_id % 19 = 0 then null
  else cast(1 + (event_id*7) % (@ORDERS + 1000) as varchar(20)) end as booking_id from {events} where event_type = 'click'""",
    "authorize_requests": """
 select event_id, case event_id % 7 when 0 then null when 1 then 'USD' when 2 then '' else 'EUR' end as currency,
 case event_id % 11 when 0 then null when 1 then '12.5' when 2 then 'x' when 3 then '2000000'
  else cast(event_id % 3000 as varchar(20)) end as amount from {events} where event_type = 'purchase'""",
    "fee_requests": """
 select event_id, case when event_id % 5 = 0 then null else event_id % 9 - 2 end as penalty_amount
 from {events} where event_type = 'error'""",
    "sessions": """
 select o_orderkey+1 as booking_id, concat('cs_new_', cast(o_orderkey+1 as varchar(20))) as session_id
 from {orders} where o_orderkey % 6 = 1""",
    "transfer_results": """
 select o_orderkey+1 as booking_id, o_orderkey % 5 <> 0 as ok,
 case when o_orderkey % 5 <> 0 then concat('tr_', cast(o_orderkey+1 as varchar(20))) end as transfer_id
 from {orders} where o_orderkey % 4 in (2,3)""",
    "old_ledger": """
 select o_orderkey+1 as booking_id from {orders} where o_orderkey % 12 = 2""",
    "manual_requests": """
 select o_orderkey+1 as booking_id from {orders} where o_orderkey % 8 in (1,5)""",
    "onboard_requests": """
 select c_custkey as request_id, case c_custkey % 9 when 0 then null when 1 then 'host_missing'
  else concat('host_', cast(c_custkey % @SUPPLIERS as varchar(20))) end as host_uid,
 case c_custkey % 4 when 0 then null when 1 then '' when 2 then ' nb ' else 'NF' end as country,
 case c_custkey % 5 when 0 then null when 1 then '' when 2 then c_name
  else concat(' ', c_name, ' ', c_mktsegment, ' jr ') end as full_name from {customer}""",
    "account_snapshots": """
 select s_suppkey as host_id, s_suppkey % 3 = 0 as payouts_enabled, s_suppkey % 2 = 0 as details_submitted,
 s_suppkey % 5 as n_currently_due, s_suppkey % 4 as n_past_due from {supplier}""",
    "app_version_config": """
 select case r_regionkey when 0 then 'client' when 1 then 'host' else concat('app', cast(r_regionkey as varchar(9))) end as app,
 r_regionkey+3 as min_build, r_regionkey+4 as latest_build, r_regionkey = 1 as force_update, 'old' as android_url,
 @TS '1998-01-01 00:00:00' as updated_at from {region}""",
    "app_links": """
 select case n_nationkey when 0 then 'client' when 1 then 'host' else concat('app', cast(n_nationkey as varchar(9))) end as app,
 0 as min_build, n_nationkey as latest_build, false as force_update,
 concat('https://store.example/', cast(n_nationkey as varchar(9))) as android_url from {nation} where n_nationkey % 3 <> 2""",
}


VIEWS["phone_hosts"] = VIEWS["hosts"].replace(
    " from {supplier}",
    ", case s_suppkey % 3 when 0 then concat(' +372 ', cast(s_suppkey as varchar(20))) when 1 then '' end as phone_number from {supplier}")
# requests with contact fields; blank ones differ from missing ones
VIEWS["contact_requests"] = VIEWS["onboard_requests"].replace(
    " from {customer}",
    """, case c_custkey % 3 when 0 then null when 1 then ' ' else concat(' c', cast(c_custkey as varchar(20)), '@mail.example ') end as email,
 case c_custkey % 5 when 0 then '' when 1 then concat('+47 ', cast(c_custkey as varchar(20))) end as phone from {customer}""")


def _text(view: str, tokens: dict[str, str]) -> str:
    text = VIEWS[view]
    for token, value in tokens.items():
        text = text.replace(token, value)
    return text


def base_tables(view: str) -> list[str]:
    return [t for t in DRIVER_SCHEMAS if "{" + t + "}" in VIEWS[view]]


def oracle_view(view: str) -> str:
    """The view's text for DuckDB."""
    return _text(view, ORACLE_TOKENS).format(**{t: t for t in base_tables(view)})


class Fixtures:
    """The views of one data directory, as DataFrames: ``Fixtures(spark, dir).trailers``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.table = lru_cache(maxsize=None)(self._table)
        self.view = lru_cache(maxsize=None)(self._view)
        self.rows = lru_cache(maxsize=None)(lambda name: self.table(name).count())

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def _spark_text(self, name: str) -> str:
        counts = {token: str(self.rows(t)) for token, t in COUNTED.items() if token in VIEWS[name]}
        return _text(name, {**SPARK_TOKENS, **counts})

    def _view(self, name: str) -> DataFrame:
        return self.spark.sql(self._spark_text(name), **{t: self.table(t) for t in base_tables(name)})

    def stream(self, name: str, table: str) -> DataFrame:
        """A view over one table, read as a stream."""
        raw = (
            self.spark.readStream.schema(DRIVER_SCHEMAS[table])
            .option("pathGlobFilter", f"{table}.parquet").parquet(self.sf_dir)
        )
        return self.spark.sql(self._spark_text(name), **{table: raw})

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)


@lru_cache(maxsize=16)
def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    """The views of a directory, put together once per session; they hold plans, not data."""
    return Fixtures(spark, sf_dir)
