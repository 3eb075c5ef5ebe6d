from helpers import entries, texts
from pyspark.sql import functions as F
from timelens.operators.quality import (
    missing_names,
    missing_slices,
    repeated_keys,
    rollup_violations,
    stray_names,
    unknown_tags,
)
from timelens.operators.slices import all_slices, rollup_base, tag_cells


def tables(spark, tags=("Work",)):
    made = entries(
        spark,
        [
            ("p", "d", list(tags), "2021-01-01 00:10:00", "2021-01-01 03:00:00"),
            ("q", "d", list(tags), "2021-02-01 00:10:00", "2021-02-02 03:00:00"),
        ],
    )
    base = rollup_base(made)
    return (
        all_slices(base, ["project"]),
        all_slices(base, ["project", "description"]),
        all_slices(tag_cells(base), ["tag"]),
    )


def test_a_sound_rollup_has_no_violations(spark):
    assert rollup_violations(*tables(spark)).count() == 0


def test_seeded_violations_are_found(spark):
    projects, groups, tags = tables(spark, ("Work", "Nonsense"))
    bad_tags = tags.filter("not (tag = 'Work' and histType = 'yearSum')")
    bad_projects = projects.unionByName(projects.filter("project = 'p' and histType = 'yearSum'"))
    bad_projects = bad_projects.withColumn("description", F.lit("d"))
    bad_groups = groups.withColumn(
        "description", F.when(F.col("project") == "q", None).otherwise(F.col("description"))
    )
    found = texts(rollup_violations(bad_projects, bad_groups, bad_tags), "check", "key", "detail")
    assert ("unknown tag", "Nonsense", "") in found
    assert ("missing slices", "Work", "15") in found
    assert ("stray column in projects", "description", "") in found
    assert ("no description in groups", "description", "null") in found
    assert any(check == "repeated key in projects" for check, *_ in found)
    assert {check for check, *_ in found} == {
        "unknown tag", "missing slices", "stray column in projects", "no description in groups",
        "repeated key in projects",
    }


def test_single_checks(spark):
    _, groups, tags = tables(spark)
    assert unknown_tags(tags, ()).count() == 1
    assert missing_slices(groups.filter("histType = 'none'"), ["project"]).count() == 0
    assert repeated_keys(tags, ["tag"], "tags").count() == 1
    assert missing_names(groups, ["project"], "groups").count() == 0
    assert stray_names(groups, ["tag"], "groups").count() == 0
