"""Registered queries outside the corpus subpackage against their SQL."""

import pytest

from chronolith.operators import asof
from chronolith.plans import corpus_queries, fact_queries

CATALOGUE = fact_queries.queries() | corpus_queries.queries()


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOGUE.items() if sql])
def test_against_sql(agree, name):
    agree(*CATALOGUE[name])


def _revs(spark, rows):
    d = spark.createDataFrame(rows, "core_id string, revision_id string, vt_start string, vt_end string, tx_id long, status string")
    return d.withColumns({c: d[c].cast("timestamp") for c in ("vt_start", "vt_end")})


def test_assertion_of_another_interval_beats_a_later_retraction(spark):
    r = _revs(spark, [("c", "a", "2015-01-01", "2025-01-01", 3, "asserted"), ("c", "b", "2010-01-01", "2020-01-01", 4, "retracted")])
    assert [x.revision_id for x in asof.winners(r, 9, "2017-01-01").collect()] == ["a"]


def test_ties_and_half_open_end(spark):
    rows = [("c", "b", "2020-01-01", "2021-01-01", 1, "asserted"), ("c", "a", "2020-01-01", "2021-01-01", 1, "asserted"), ("d", "z", "2020-01-01", None, 1, "asserted"), ("d", "y", "2020-01-01", None, 1, "retracted")]
    got = {x.core_id: (x.revision_id, x.status) for x in asof.winners(_revs(spark, rows), 1, "2020-06-01").collect()}
    assert got == {"c": ("a", "asserted"), "d": ("y", "retracted")}
    assert {x.core_id for x in asof.winners(_revs(spark, rows), 1, "2021-01-01").collect()} == {"d"}
