"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__
from verification import oracle, registry
from verification.compare import compare, sql_connection

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return sql_connection(SF_DIR)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(oracle.oracle_sql())


def chosen() -> list[str]:
    """One query of each family; all of them with CHECK_ALL=1 or verification.compare.

    The slices left out here are compared as parts of all_slices, in SQL below
    and by hand in test_rollups.
    """
    names = list(registry.queries())
    if os.environ.get("CHECK_ALL"):
        return names
    families = {
        "hist_": ("hist_json_project", "hist_project_hourMonthCount", "hist_tag_dayYearCount"),
        "series_": ("series_project_monthYearCount", "series_group_yearSum", "series_tag_dayCount"),
        "page_": ("page_g1_group", "page_g3_tag", "page_g7_group", "page_g8_heatmap", "page_live_tag_events"),
        "events_": ("events_hist_group_hourDayCount",),
        "document_by_": ("document_by_time_top",),
        "nested_maps_": ("nested_maps_dayMonthYearCount",),
        "quality_": ("quality_violations_events", "quality_violations_seeded"),
        "all_slices_": ("all_slices_group", "all_slices_tag"),
        "stored_slices_": ("stored_slices_tag",),
        "grown_slices_": ("grown_slices_group", "grown_slices_tag"),
        "rollup_tables": (),
        "calendar_heatmap": (),
        "top_": ("top_total_per_type",),
    }
    for prefix, kept in families.items():
        names = [n for n in names if not n.startswith(prefix) or n in kept]
    return names


@pytest.mark.parametrize("name", chosen())
def test_query(spark, con, name):
    assert compare(spark, con, SF_DIR, name) == ""


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["project", "description", "name", "bucket", "label", "value", "value_label"]
    assert rows.count() > 0
