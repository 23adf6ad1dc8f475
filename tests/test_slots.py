"""Slots of the queries on ``events``."""

import pytest

from tideline.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_spectra_are_of_whole_histories(spark):
    """A row per user, in the query and its SQL: cut into weeks, no spectrum reaches below one cycle a week."""
    duckdb = pytest.importorskip("duckdb")
    users = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    got = QUERIES["slot_spectra"](spark, SF).collect()
    assert len(got) == users == len({r.user_id for r in got})
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{SF}/events.parquet'")
    assert db.execute(f"select count(*), count(distinct user_id) from ({ORACLE_SQL['slot_spectra']})").fetchone() == (users, users)
