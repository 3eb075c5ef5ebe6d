import datetime

import pytest
from pyspark.sql import functions as F

from helpers import texts
from timelens.fixed_values import (
    CSV_COLUMNS,
    DESCRIPTION_TAG_RULES,
    PROJECT_TAG_RULES,
    TAGS,
)
from timelens.operators.entries import (
    clean_entries,
    decode_tags,
    encode_tags,
    entries_from_export,
    format_iso,
    tag_entries,
)
from timelens.session import new_work_dir
from timelens.sources.csv_entries import scan_csv, write_csv
from timelens.sources.tables import check_written, read_table, write_table

# One text that matches and one that does not, per rule.
PROJECT_CASES = {
    "Hustle": ("LEHT club", "let"),
    "Beyond": ("Kitchen work", "kitch"),
    "Community": ("Hacker Refactor", "factor"),
    "Fun": ("avalanche course", "avalanch"),
    "Exercise": ("My exercises", "exercis"),
    "New": ("MotorCycle", "motor"),
    "Dogs": ("hotdogs", "d o g"),
    "Paid": ("pika study", "pik"),
    "School": ("CS 461", "CS 46"),
    "Scholarship": ("Scholarships", "scholar"),
    "Compost": ("Capstone", "cap stone"),
}

DESCRIPTION_CASES = {
    "Apply": ("job application", "app"),
    "Meeting": ("Meetings", "met"),
    "Networking": ("attend a talk", "atend"),
    "Resume": ("resumed", "resum"),
    "Research": ("RESEARCH", "search"),
    "Community": ("TRIO panel", "tri"),
    "Scholarship": ("cannot afford", "for"),
    "Beyond": ("a thank you letter", "thanks"),
    "Work": ("Homework", "wor"),
    "Email": ("newsletter", "mail"),
    "Compost": ("compost bin", "compos"),
    "Dogs": ("walk the Dog", "do"),
    "New": ("make skins", "ski"),
    "Exercise": ("exercise", "exer"),
    "PNNL": ("Search for apartment", "apart"),
}


def tags_for(spark, rows):
    made = spark.createDataFrame(rows, "id int, project string, description string")
    return {r["id"]: list(r["type"]) for r in tag_entries(made).collect()}


def test_every_rule_matches_and_does_not_match(spark):
    assert set(PROJECT_CASES) == {tag for tag, _ in PROJECT_TAG_RULES}
    assert set(DESCRIPTION_CASES) == {tag for tag, _ in DESCRIPTION_TAG_RULES}
    rows, wanted = [], []
    for field, cases in enumerate((PROJECT_CASES, DESCRIPTION_CASES)):
        for tag, (hit, miss) in cases.items():
            for text, found in ((hit, True), (miss, False)):
                names = (text, "") if field == 0 else ("", text)
                rows.append((len(rows), *names))
                wanted.append((tag, found))
    tags = tags_for(spark, rows)
    for i, (tag, found) in enumerate(wanted):
        assert (tag in tags[i]) is found, (rows[i], tags[i])


def test_tags_keep_rule_order_once_each(spark):
    tags = tags_for(
        spark,
        [
            (0, "Hacker Refactor", "sacnas exercise"),
            (1, "Exercise", "Exercise"),
            (2, "", ""),
            (3, "Class", "x"),
            (4, "Classroom", "x"),
            (5, "class\n", "x"),
        ],
    )
    assert tags[0] == ["Beyond", "Community", "Exercise"]
    assert tags[1] == ["Fun", "Exercise"]
    assert tags[2] == ["UNKNOWN"]
    assert tags[3] == ["School"]
    assert tags[4] == tags[5] == ["UNKNOWN"]


def test_letters_outside_ascii_do_not_match(spark):
    # Their lower case starts with an ASCII i and k.
    tags = tags_for(spark, [(0, "", "skİn"), (1, "pİka", ""), (2, "", "worK"), (3, "", "SKIN")])
    assert tags == {0: ["UNKNOWN"], 1: ["UNKNOWN"], 2: ["UNKNOWN"], 3: ["New"]}


def test_all_rule_tags_are_listed():
    assert {tag for tag, _ in PROJECT_TAG_RULES + DESCRIPTION_TAG_RULES} <= set(TAGS)


def test_cleaning(spark):
    rows = [
        (0, "", "Exercise", "No"),
        (1, "", "exercise", "Yes"),
        (2, "Get Hired at Dream Job", "Prepare for SACNAS", "maybe"),
        (3, "Get Hired at Dream Job", "Search for housing", ""),
        (4, "CS 461 Capstone", "Homwork", "no"),
        (5, "Other", "Homwork", "No"),
    ]
    made = spark.createDataFrame(rows, "id int, project string, description string, billable string")
    found = {r["id"]: (r["project"], r["description"], r["billable"]) for r in clean_entries(made).collect()}
    assert found == {
        0: ("Exercise", "Exercise", 0),
        1: ("", "exercise", 1),
        2: ("Get Hired at Dream Job", "Prepare for SACNAS - Network", 1),
        3: ("Get Hired at Dream Job", "Search for apartment", 1),
        4: ("CS 461 Capstone", "Homework", 1),
        5: ("Other", "Homwork", 0),
    }


def export_line(spark, out, lines):
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(out)


HEADER = ",".join(CSV_COLUMNS)


def test_csv_positions_quotes_and_empty_text(spark):
    out = new_work_dir(spark, "csv")
    export_line(
        spark,
        out,
        [
            HEADER.replace("Project", "Renamed"),
            'u,e,,"Class, late",,"said ""hi""",No,2021-12-13,14:50:00,2021-12-13,15:10:01,00:20:01,',
            'u,e,,"",,Exercise,Yes,2021-12-13,15:10:00,2021-12-13,14:50:00,x,a',
        ],
    )
    rows = entries_from_export(scan_csv(spark, out)).orderBy("duration").collect()
    assert [r["duration"] for r in rows] == [-1200, 1201]
    assert (rows[1]["project"], rows[1]["description"]) == ("Class, late", 'said "hi"')
    assert rows[0]["project"] == "Exercise" and rows[0]["billable"] == 1
    assert rows[1]["start"] == datetime.datetime(2021, 12, 13, 14, 50)
    assert [f.name for f in entries_from_export(scan_csv(spark, out)).schema] == [
        "project", "description", "type", "billable", "start", "end", "duration",
    ]


@pytest.mark.parametrize(
    "line",
    [
        "u,e,,p,,d,No,2021-12-13,14:50:00",
        "u,e,,p,,d,No,2021-12-13,14:50:00,2021-12-13,15:10:00,x,t,one,too,many",
        "u,e,,p,,d,No,not a date,14:50:00,2021-12-13,15:10:00,x,t",
    ],
)
def test_malformed_rows_fail(spark, line):
    out = new_work_dir(spark, "csv")
    export_line(spark, out, [HEADER, line])
    with pytest.raises(Exception):
        entries_from_export(scan_csv(spark, out)).collect()


def test_multiline_fields(spark):
    out = new_work_dir(spark, "csv")
    export_line(
        spark,
        out,
        [HEADER, 'u,e,,p,,"two\nlines",No,2021-12-13,14:50:00,2021-12-13,15:10:00,x,t'],
    )
    rows = entries_from_export(scan_csv(spark, out, multiline=True)).collect()
    assert [r["description"] for r in rows] == ["two\nlines"]
    with pytest.raises(Exception):
        entries_from_export(scan_csv(spark, out)).collect()


def test_many_files_are_one_table(spark):
    paths = []
    for year in (2020, 2021):
        out = new_work_dir(spark, "csv")
        export_line(spark, out, [HEADER, f"u,e,,p,,d,No,{year}-01-01,00:00:00,{year}-01-01,01:00:00,x,t"])
        paths.append(out)
    rows = entries_from_export(scan_csv(spark, paths))
    assert texts(rows, "start", "duration") == [
        ("2020-01-01 00:00:00", "3600"),
        ("2021-01-01 00:00:00", "3600"),
    ]


def test_csv_written_and_read_back(spark):
    out = new_work_dir(spark, "csv")
    row = ("u", "e", "", "a|b, c", "", 'x "y"', "No", "2021-01-01", "00:00:00", "2021-01-01", "00:00:01", "", "")
    write_csv(spark.createDataFrame([row], ", ".join(f"`{c}` string" for c in CSV_COLUMNS)), out)
    found = scan_csv(spark, out).first()
    assert (found["project"], found["description"]) == ("a|b, c", 'x "y"')


def test_text_forms(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    one = spark.range(1).select(
        F.to_timestamp(F.lit("2021-12-13 14:14:45")).alias("t"),
        F.array(F.lit("A"), F.lit("B")).alias("tags"),
    )
    found = one.select(
        format_iso(F.col("t")).alias("iso"),
        encode_tags(F.col("tags")).alias("json"),
        decode_tags(encode_tags(F.col("tags"))).alias("back"),
    ).first()
    assert found["iso"] == "2021-12-13T14:14:45-08:00"
    assert found["json"] == '["A","B"]' and found["back"] == ["A", "B"]


def test_written_rows_are_counted(spark):
    out = new_work_dir(spark, "table")
    ten = write_table(spark.range(10), out)
    assert ten.rows == 10
    check_written(spark, out, ten)
    three = write_table(spark.range(3).withColumn("p", F.col("id") % 2), out, ["p"], check=True)
    assert three.rows == 3 and read_table(spark, out).count() == 3
    with pytest.raises(ValueError):
        check_written(spark, out, three._replace(rows=4))
    write_table(spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "id bigint, p bigint"), out)
    with pytest.raises(ValueError):  # one row lost, another one there twice
        check_written(spark, out, three)
