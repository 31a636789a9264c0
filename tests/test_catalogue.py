"""Every registered query beside its DuckDB SQL on the smallest tables, and the stream forms beside the batch form."""

import datetime
import decimal
import glob
import os

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tidemark.functions.times import HOUR
from tidemark.operators import rollups as R
from tidemark.plans import catalogue, oracle

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return None if value != value else round(float(value), 4)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    cursor = duck.execute(oracle.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    want = sorted(repr([plain(v) for _, v in sorted(zip(columns, row, strict=True))]) for row in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in order]) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(oracle.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def far_estimates(exact, near, keys, name):
    """Rows of ``exact``, how many of them ``near`` has, and how many estimates are off by over 5% (small counts: by one)."""
    both = exact.select(*keys, name).join(near.select(*keys, near[name].alias("estimate")), keys)
    return exact.count(), both.count(), both.where(f"abs({name} - estimate) > 0.05 * {name} + 0.5").count()


@pytest.mark.parametrize(("name", "column"), [("minute_stats", "active_users"), ("minute_stats", "open_users"), ("presence_minute", "sessions"), ("presence_minute", "users")])
def test_sketch_estimates_are_near_the_exact_counts(spark, name, column):
    exact, near = catalogue.QUERIES[name](spark, DATA), catalogue.QUERIES[f"{name}_sketch"](spark, DATA)
    keys = [c for c in exact.columns if c not in ("active_sessions", "open_sessions", "active_users", "open_users", "sessions", "users")]
    rows, met, far = far_estimates(exact, near, keys, column)
    assert rows == met and far == 0


def test_hourly_sketches_count_each_user_once(spark):
    m = catalogue.Model(spark, DATA)
    keys = ["bucket", "platform", "country", "video_resolution", "content_id"]
    near = R.estimated_users(R.rolled_stats(R.minute_stats(m.minutes, m.open_minutes, sketches=True), HOUR))
    exact = m.minutes.withColumn("bucket", F.expr(f"minute div {HOUR} * {HOUR}")).groupBy(*keys).agg(F.countDistinct("user_id").alias("active_users"))
    rows, met, far = far_estimates(exact, near, keys, "active_users")
    assert rows == met > 0 and far == 0


def test_entry(spark):
    assert entry_module.entry(spark).count() == 60


def test_whole_history_is_seen(spark):
    """FIXTURES.md: the peak of sf 0.01 is 44 in minute 2, outside the default window."""
    (row,) = catalogue.QUERIES["peak_summary_whole"](spark, "/root/testdata/sf0.01").collect()
    assert (row["peak"], row["peak_minute"], row["occupied_minutes"]) == (44, datetime.datetime(2024, 1, 1, 0, 2), 146)
    assert catalogue.QUERIES["local_peaks_whole"](spark, DATA).count() == 6


def test_checks_see_every_minute(spark):
    m = catalogue.Model(spark, DATA)
    dip = m.deltas.limit(1).select(*[c for c in m.deltas.columns if c not in ("minute", "delta_sessions", "delta_open")])
    rows = [dip.selectExpr("*", f"cast({oracle.W0 - at} as long) as minute", f"cast({d} as long) as delta_sessions", "0L as delta_open") for at, d in ((20, -1000), (10, 1000))]
    m.deltas = m.deltas.unionByName(rows[0]).unionByName(rows[1])
    got = {r["check"]: r for r in catalogue.data_checks(m).collect()}
    assert all(got[c]["observed"] == 10 and not got[c]["ok"] for c in ("negative_minutes", "curve_against_occupancy"))
