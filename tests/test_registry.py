"""Every named query against its SQL over whole tables, at the smallest scale."""

from __future__ import annotations

import compare
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
EMPTY = "no rows on either side"


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    note = compare.difference(spark, FOLDER, entry.queries()[name], entry.oracle_sql()[name], con)
    assert note in (None, EMPTY)


def test_whole_job_over_line_items(spark):
    out = entry.queries()["processed_shipments"](spark, FOLDER)
    scaled = [c for c in out.columns if c.startswith("s") and c[1:].isdigit()]
    assert out.count() > 0 and scaled == [f"s{i}" for i in range(15)]
    assert out.select(*[F.count(c) for c in scaled]).first()[0] > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
