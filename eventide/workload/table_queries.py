"""Registered queries: manifests, identities, provenance, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from eventide.core.lineage import shared_folder
from eventide.sinks import provenance as pv
from eventide.sinks.tables import pending, write_sessions
from eventide.sources import identity as idn
from eventide.sources import manifest as mf
from eventide.sources import sessions as se
from eventide.workload import tables as tb
from eventide.workload.event_queries import found_pulses, INTERNAL_PULSES
from eventide.workload.registry import query


def sessions(spark, path):
    """Customers as a session manifest with untidy labels."""
    return tb.read(spark, path, "customer").select(
        F.concat(F.lit("  M"), F.pmod("c_custkey", F.lit(40)).cast("string"), F.lit(" ")).alias("mouse"),
        F.format_string("%06d", F.pmod("c_custkey", F.lit(7)) + 240101).alias("date"),
        F.concat(F.lit(" "), F.pmod("c_custkey", F.lit(6)).cast("string")).alias("run"),
        F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("group"),
        F.when(F.col("c_nationkey") < 12, "dry").otherwise("Wet ").alias("condition"),
        F.when(F.col("c_nationkey") % 3 == 0, "").otherwise((F.col("c_nationkey") % 3).cast("string")).alias("channel"),
        "c_custkey",
    )


MANIFEST = """s AS (SELECT c_custkey, 'M' || (c_custkey % 40) AS mouse, printf('%06d', c_custkey % 7 + 240101) AS date,
      CAST(c_custkey % 6 AS INTEGER) AS run, lower(c_mktsegment) AS grp,
      CASE WHEN c_nationkey < 12 THEN 'dry' ELSE 'wet' END AS cond,
      CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE c_nationkey % 3 END AS channel FROM customer)"""


@query(
    "session_store",
    """WITH ev AS (SELECT 's' || (user_id % 5) AS session_id, event_type AS signal, value AS v FROM events)
    SELECT session_id, signal, count(*) AS n, round(sum(v), 4) AS total FROM ev GROUP BY ALL""",
)
def session_store(spark, path):
    """Sessions written one after the other, one of them twice, and read together."""
    ev = tb.raw_events(spark, path).select(
        F.concat(F.lit("s"), F.pmod("mouse", F.lit(5)).cast("string")).alias("session_id"),
        F.col("kind").alias("signal"), F.col("event_id").cast("bigint").alias("i"), "t", "v")
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    first = F.col("session_id").isin("s0", "s1")
    write_sessions({"signals": ev.filter(first).withColumn("v", F.lit(0.0))}, root)
    write_sessions({"signals": ev.filter(~first)}, root)
    write_sessions({"signals": ev.filter(first)}, root)
    stored = spark.read.schema(se.SCHEMAS["signals"]).parquet(f"{root}/signals")
    return stored.groupBy("session_id", "signal").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query(
    "duplicate_guard",
    f"WITH {MANIFEST} SELECT mouse, date, run, count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_guard(spark, path):
    return mf.duplicates(sessions(spark, path))


@query(
    "duplicate_guard_folded",
    f"WITH {MANIFEST} SELECT lower(mouse) AS mouse, date, run, count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_guard_folded(spark, path):
    return mf.duplicates(sessions(spark, path), fold_case=True)


@query(
    "manifest_filter",
    f"WITH {MANIFEST} SELECT c_custkey FROM s WHERE grp = 'building' AND cond = 'wet'",
)
def manifest_filter(spark, path):
    return mf.select_sessions(sessions(spark, path), group="Building ", condition="WET").select("c_custkey")


@query(
    "channel_resolve",
    f"WITH {MANIFEST} SELECT channel, count(*) AS n FROM s GROUP BY channel",
)
def channel_resolve(spark, path):
    return sessions(spark, path).groupBy(mf.channel().alias("channel")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "identity_codec",
    """SELECT o_orderkey, 'M' || o_custkey AS mouse, strftime(o_orderdate, '%y%m%d') AS date,
      CAST(o_orderkey % 1000 AS INTEGER) AS run,
      'M' || o_custkey || '_' || strftime(o_orderdate, '%y%m%d') || '_run' || printf('%03d', o_orderkey % 1000) AS session_id,
      '/data/M' || o_custkey || '/M' || o_custkey || '_' || strftime(o_orderdate, '%y%m%d') || '/M' || o_custkey || '-'
        || strftime(o_orderdate, '%y%m%d') || '-' || printf('%03d', o_orderkey % 1000) || '-nidaq.mat' AS nidaq
    FROM orders""",
)
def identity_codec(spark, path):
    o = tb.read(spark, path, "orders")
    day = F.date_format(F.to_date("o_orderdate"), "yyMMdd")
    mouse = F.concat(F.lit("M"), F.col("o_custkey").cast("string"))
    run = F.pmod("o_orderkey", F.lit(1000)).cast("int")
    name = F.when(
        F.col("o_orderkey") % 2 == 0, F.format_string("/rec/%s_%s_run%d_0000.doric", day, mouse, run)
    ).otherwise(F.format_string("/rec/%s_%s_run%d_0000.doric", mouse, day, run))
    x = o.select("o_orderkey", idn.identity(name).alias("who")).select("o_orderkey", "who.*")
    m, d, r = F.col("mouse"), F.col("date"), F.col("run")
    return x.select(
        "o_orderkey", "mouse", "date", "run", idn.session_id(m, d, r).alias("session_id"),
        idn.nidaq_path("/data", m, d, r).alias("nidaq"),
    )


@query(
    "ambiguous_files",
    """SELECT 'M' || (o_custkey % 97) AS mouse, strftime(o_orderdate, '%y%m%d') AS date, CAST(o_orderkey % 3 AS INTEGER) AS run,
      count(*) AS n_files, count(*) > 1 AS ambiguous FROM orders GROUP BY ALL""",
)
def ambiguous_files(spark, path):
    o = tb.read(spark, path, "orders")
    day = F.date_format(F.to_date("o_orderdate"), "yyMMdd")
    name = F.format_string(
        "/z/%d/M%d-%s-%03d-nidaq.mat", F.col("o_orderkey"), F.pmod("o_custkey", F.lit(97)), day,
        F.pmod("o_orderkey", F.lit(3)).cast("int"),
    )
    files = o.select(name.alias("path")).withColumn("w", idn.identity("path")).select("path", "w.*")
    return idn.candidates(files).select("mouse", "date", "run", "n_files", "ambiguous")


@query(
    "semantic_channel",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'licking' WHEN 'view' THEN 'sync' WHEN 'purchase' THEN 'ensure'
      ELSE event_type END AS channel FROM events""",
)
def semantic_channel(spark, path):
    e = tb.read(spark, path, "events")
    user = (
        F.when(F.col("event_type") == "click", " Lick-Event ")
        .when(F.col("event_type") == "view", "Cam pulse")
        .when(F.col("event_type") == "purchase", "ENSURE delivery")
        .when(F.col("event_type") == "error", "")
        .otherwise(F.concat(F.lit(" "), F.col("event_type")))
    )
    return e.select("event_id", idn.semantic_channel(user, "event_type").alias("channel"))


@query(
    "safe_label",
    """SELECT page_id, regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS label
    FROM pages""",
)
def safe_label(spark, path):
    return tb.read(spark, path, "pages").select("page_id", idn.safe_label("url").alias("label"))


@query(
    "fingerprint",
    """SELECT s_suppkey, sha256('{"bal":' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) || ',"name":"' || s_name
      || '","nation":' || s_nationkey || '}') AS sha FROM supplier""",
)
def fingerprint(spark, path):
    s = tb.read(spark, path, "supplier")
    sha = pv.fingerprint_column(
        {"name": F.col("s_name"), "nation": F.col("s_nationkey"), "bal": F.floor("s_acctbal").cast("bigint")}
    )
    return s.select("s_suppkey", sha.alias("sha"))


@query(
    "staleness_case",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'unknown_version'
      WHEN o_orderpriority <> '1-URGENT' AND o_orderkey % 5 = 0 THEN 'older_schema' WHEN o_orderstatus = 'P' THEN 'dirty_code'
      WHEN o_orderkey % 13 = 0 THEN 'unknown_version' WHEN o_totalprice >= 250000 THEN 'settings_changed'
      WHEN o_custkey % 9 = 0 THEN 'unknown_version' WHEN o_custkey % 2 = 0 THEN 'different_commit' ELSE 'current' END AS state
    FROM orders""",
)
def staleness_case(spark, path):
    o = tb.read(spark, path, "orders")
    k = F.col("o_orderkey")
    old = (F.col("o_orderpriority") != "1-URGENT") & (k % 5 == 0)
    state = pv.staleness(
        exists=k % 11 != 0,
        readable=k % 7 != 0,
        schema_version=F.when(old, "0.9").otherwise("1.0"),
        dirty=F.col("o_orderstatus") == "P",
        stored_fingerprint=F.when(k % 13 == 0, "").when(F.col("o_totalprice") >= 250000, "b").otherwise("a"),
        stored_commit=F.when(F.col("o_custkey") % 9 == 0, "").when(F.col("o_custkey") % 2 == 0, "c1").otherwise("c0"),
        expected_schema="1.0", expected_fingerprint="a", current_commit="c0",
    )
    return o.select("o_orderkey", state.alias("state"))


@query(
    "pending_sessions",
    f"WITH {MANIFEST} SELECT c_custkey FROM s WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
)
def pending_sessions(spark, path):
    done = tb.read(spark, path, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return pending(sessions(spark, path), done, ["c_custkey"]).select("c_custkey")


@query(
    "display_units",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN round(l_quantity * 1000.0, 6) ELSE l_quantity END AS v
    FROM lineitem""",
)
def display_units(spark, path):
    l = tb.read(spark, path, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"), F.lit("ns").alias("units"),
        F.when(F.col("l_returnflag") == "A", "tau").when(F.col("l_returnflag") == "R", "mpet").otherwise("photons").alias("signal"),
    )
    return l.select("l_orderkey", "l_linenumber", F.round(se.display_value(), 6).alias("v"))


@query(
    "overlapping_intervals",
    f"WITH {INTERNAL_PULSES} SELECT mouse, onset_t AS t0, offset_t AS t1 FROM pulses WHERE offset_t >= 1704672000.0 AND onset_t <= 1705276800.0",
)
def overlapping_intervals(spark, path):
    found, _ = found_pulses(spark, path)
    x = found.select("mouse", F.col("onset_t").alias("t0"), F.col("offset_t").alias("t1"))
    return se.overlapping(x, (1704672000.0, 1705276800.0))


@query(
    "json_metadata",
    """SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n, round(avg(value), 6) AS mean
    FROM events GROUP BY 1""",
)
def json_metadata(spark, path):
    e = tb.read(spark, path, "events")
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    return e.groupBy(k).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")
    )
