"""Catalog queries against DuckDB.  A cross-section by default, everything with PLANLENS_FULL=1."""

import os

import pytest

from planlens.catalog import QUERIES, SQL
from tests.compare import compare, duck

SMALL = "/root/testdata/sf0.001"
CROSS_SECTION = ["revenue_by_nation", "src2_detected_types", "snk7_merge_facts", "prj3_calculated_field", "flt8_multi_value_absent", "jon9_resolve_groups", "agg2_chart_median", "agg6_heatmap",
                 "agg24_group_numerator_max", "win4_latest_cumulative", "sta2_numeric_profile", "sta9_spearman_nulls", "sta15_mann_whitney", "imp5_linear", "enc7_leave_one_out", "out3_robust_zscore",
                 "tsr6_spline_fill", "spl4_group", "tsa4_decompose", "ind3_plan_ratio", "ind11_monthly_series", "ind16_organization_coverage", "ind27_applicability", "ind36_gap_summary"]
NAMES = sorted(QUERIES) if os.environ.get("PLANLENS_FULL") else CROSS_SECTION


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    rows, state = compare(spark, con, name, SMALL)
    assert state in ("ok", "rows-only", "EMPTY"), state


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
