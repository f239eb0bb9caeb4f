"""Every catalogue query against its SQL twin on the smallest tables."""

import os

import pytest

from oracle import DATA, compare, connect

#: Hundreds of trees in passes of about 0.2 s, whatever the size of the tables: two to four minutes each.
#: test_fitted.py holds their operators against plain Python; tests/oracle.py runs them.
LONG = {"cross_fit_boosted", "reliability_boosted", "family_contribution"}
SF = os.environ.get("SIGLOOM_TEST_SF", "0.001")


def names():
    from sigloom.plans import catalog

    return [n for n in catalog.QUERIES if n not in LONG]


@pytest.fixture(scope="module")
def con():
    return connect(DATA.format(SF))


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    from sigloom.plans import catalog

    problem = compare(spark, con, DATA.format(SF), name, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert problem is None, problem


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Signals of which one (641) has two equal bends in its event curve."""
    folder = str(tmp_path_factory.mktemp("tied"))
    connect(DATA.format("0.1")).execute(f"COPY (SELECT * FROM embeddings WHERE vec_id BETWEEN 600 AND 680) TO '{folder}/embeddings.parquet'")
    return folder


@pytest.mark.parametrize("threads", [1, 4])
@pytest.mark.parametrize("name", ["knee_counts", "detect_current", "event_localization", "event_spacing", "cwt_features"])
def test_equal_bends_do_not_part_query_and_sql(spark, tied, name, threads):
    from sigloom.plans import catalog

    con = connect(tied)
    con.execute(f"SET threads = {threads}")
    assert compare(spark, con, tied, name, catalog.QUERIES[name], catalog.ORACLES[name]) is None
