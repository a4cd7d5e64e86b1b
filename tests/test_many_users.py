"""Queries held against SQL on events of more users than there are ports, whose times don't rise with their ids."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = ["decode_udp", "flow_agg", "flow_app_upgrade", "flow_lookup", "flow_sessions", "global_stats", "multi_file_flows", "multi_file_verdicts", "rule_port_anti", "stage_breakdown", "sticky_block", "verdict_reason", "bottleneck", "canonical_key", "decode_tcp", "flow_agg_directional", "quick_tuples"]
#: Added to user ids: within 16 bits, at their end, where the lowest 16 bits of a port are those of a service, and far beyond.
SHIFTS = (0, 25_500, 65_536 + 6_999 - 40_000 - 9, 16 * 6_999 - 40_000, 90_000, 3_000_000_000)


@pytest.fixture(scope="module")
def many(sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("many")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE TABLE few AS SELECT * FROM '{sf}/events.parquet'")
    n = con.execute("SELECT max(event_id) + 1 FROM few").fetchone()[0]
    copies = " UNION ALL ".join(f"SELECT * REPLACE (event_id + {k * n} AS event_id, user_id + {shift} AS user_id) FROM few" for k, shift in enumerate(SHIFTS))
    con.execute(f"CREATE TABLE events AS {copies}")
    con.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    return con, str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_ports_beyond_16_bits(spark, many, name):
    con, folder = many
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(columns).collect())


#: Queries held against SQL on users whose ports need more than 32 bits.
FAR = ["verdict_reason", "flow_agg", "flow_app_upgrade", "flow_sessions", "rule_port_anti", "stage_breakdown", "sticky_block", "bottleneck", "canonical_key"]
#: Added to user ids: about 32 bits, at the port of a rule in the lowest bits of either half, and up to 48 bits.
FAR_SHIFTS = (2**32 - 40_000 - 7, 10**8 * 59, (6_999 << 32) + 6_999 - 40_000 - 9, 2**48 - 40_000 - 1_500)


def compared(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(columns).collect())


def changed(sf, folder, *selects):
    """A folder with events of each select, of few, the events of sf."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE few AS SELECT * FROM '{sf}/events.parquet'")
    con.execute(f"COPY ({' UNION ALL '.join(selects)}) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def far(sf, tmp_path_factory):
    copies = [f"SELECT * REPLACE (event_id + {k} * (SELECT max(event_id) + 1 FROM few) AS event_id, user_id + {shift} AS user_id) FROM few" for k, shift in enumerate(FAR_SHIFTS)]
    return changed(sf, tmp_path_factory.mktemp("far"), *copies)


@pytest.mark.parametrize("name", FAR)
def test_ports_beyond_32_bits(spark, far, name):
    compared(spark, far, name)


def test_ports_beyond_48_bits_are_refused(spark, sf, tmp_path):
    folder = changed(sf, tmp_path, f"SELECT * REPLACE (user_id + {2**48} AS user_id) FROM few")
    with pytest.raises(Exception, match="no room for the port of user"):
        entry.queries()["decode_tcp"](spark, folder).collect()


def test_flows_of_events_before_1970(spark, sf, tmp_path):
    compared(spark, changed(sf, tmp_path, "SELECT * REPLACE (ts - INTERVAL 80 YEAR AS ts) FROM few"), "flow_agg")


def test_flows_of_events_without_time(spark, sf, tmp_path):
    compared(spark, changed(sf, tmp_path, "SELECT * REPLACE (CASE WHEN event_id % 5 > 0 THEN ts END AS ts) FROM few"), "flow_agg")
