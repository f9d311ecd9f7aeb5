"""The catalogue and its SQL agree on the smallest tables."""

import pytest

from foldwise.plans import catalog
from tests.compare import compare, connect

QUICK = (
    "group_empty_summary", "support_sink_audit", "largest_remainder_counts", "norm_pr", "spearman", "ks_two_sample",
    "align_with_ordinal", "group_kfold", "lpt_bin_packing", "split_leakage", "leader_pick", "summary_values",
)


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, tiny, name):
    verdict, _ = compare(spark, tiny, connect(tiny), name, catalog.queries()[name], catalog.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_entry(spark, tiny):
    import __spark_entry__ as entry

    assert "normPR" in entry.entry(spark).columns
