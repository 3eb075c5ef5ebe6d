"""The same questions in SQL, for a side-by-side check on the same tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from timelens.fixed_values import (
    CHART_SLICES,
    DAYS,
    DESCRIPTION_TAG_RULES,
    HOURS,
    MONTH_NAMES,
    MONTHS,
    PROJECT_TAG_RULES,
    SLICES,
    TAGS,
    WEEKDAY_NAMES,
)
from verification.fixtures import DESCRIPTIONS, PROJECTS
from verification.registry import (
    EVENT_SLICES,
    GROUP_MONTH,
    GROUP_YEAR,
    LOCAL_ZONE,
    NESTED_SLICES,
    OWN_RULES,
    PAGES,
    SYLLABLES,
    TAG_MONTH,
    TAG_YEAR,
)

KEYS = {"project": ["project"], "group": ["project", "description"], "tag": ["tag"]}
LEVEL_FORMAT = {"year": "%Y", "month": "%m", "day": "%w", "hour": "%H"}
AXES = {"hour": HOURS, "day": DAYS, "month": MONTHS}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: Sequence[str]) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _rules() -> str:
    rows = []
    for field, rules in (("p", PROJECT_TAG_RULES), ("d", DESCRIPTION_TAG_RULES)):
        for tag, pattern in rules:
            pattern = pattern.replace(r"\d", "[0-9]").replace(r"\z", "$")
            rows.append(f"({len(rows)}, '{field}', {_text(tag)}, {_text(pattern)})")
    return ", ".join(rows)


RAW = f"""
raw AS (
  SELECT o_orderkey AS entry_id,
    ({_list(PROJECTS)})[o_orderkey % 11 + 1] AS project,
    ({_list(DESCRIPTIONS)})[o_orderkey % 13 + 1] AS description,
    CASE WHEN o_orderkey % 3 = 0 THEN 'No' ELSE 'Yes' END AS billable,
    o_orderdate + (o_orderkey * 37 % 1440) * interval 1 minute AS "start",
    o_orderdate + (o_orderkey * 37 % 1440 + o_custkey * 7 % 300) * interval 1 minute AS "end",
    (o_custkey * 7 % 300) * 60 AS duration
  FROM orders
),
projected AS (
  SELECT * REPLACE (
    CASE WHEN project = '' AND description = 'Exercise' THEN 'Exercise' ELSE project END AS project
  ) FROM raw
),
cleaned AS (
  SELECT * REPLACE (
    CASE
      WHEN project = 'Get Hired at Dream Job' AND description = 'Prepare for SACNAS'
        THEN 'Prepare for SACNAS - Network'
      WHEN project = 'Get Hired at Dream Job' AND description = 'Search for housing'
        THEN 'Search for apartment'
      WHEN project = 'CS 461 Capstone' AND description = 'Homwork' THEN 'Homework'
      ELSE description
    END AS description,
    CASE WHEN billable = 'No' THEN 0 ELSE 1 END AS billable
  ) FROM projected
)"""

RULES = f"rules(idx, field, tag, pattern) AS (VALUES {_rules()})"


def _tagging(source: str, project: str, description: str) -> str:
    """Distinct (project, description) pairs of a source with their tags in rule order."""
    return f"""
pairs AS (SELECT DISTINCT {project} AS project, {description} AS description FROM {source}),
hits AS (
  SELECT p.project, p.description, r.tag, min(r.idx) AS idx
  FROM pairs p JOIN rules r
    ON regexp_matches(CASE WHEN r.field = 'p' THEN p.project ELSE p.description END, r.pattern, 'i')
  GROUP BY ALL
),
pair_tags AS (
  SELECT p.project, p.description,
    coalesce(list(h.tag ORDER BY h.idx) FILTER (h.tag IS NOT NULL), ['UNKNOWN']) AS types
  FROM pairs p LEFT JOIN hits h USING (project, description)
  GROUP BY ALL
)"""


ENTRIES = f"""{RAW},
{RULES},
{_tagging("cleaned", "project", "description")},
entries AS (SELECT c.*, t.types FROM cleaned c JOIN pair_tags t USING (project, description))"""

EVENTS = """
entries AS (
  SELECT *, "start" + duration * interval 1 second AS "end" FROM (
    SELECT event_id AS entry_id, event_type AS project,
      'user ' || (user_id % 10) AS description, [event_type] AS types,
      date_trunc('second', ts) AS "start", CAST(round(value * 60) AS BIGINT) AS duration
    FROM events)
)"""

HOURED = """
houred AS (
  SELECT *, "start" + k * interval 1 hour AS startdate FROM (
    SELECT *, unnest(generate_series(0, greatest(0, date_diff('hour',
      date_trunc('hour', "start"), date_trunc('hour', "end"))))) AS k
    FROM entries)
)"""

TAGGED = "tagged AS (SELECT * EXCLUDE (types), unnest(types) AS tag FROM houred)"


LOCAL_HOURS = f"""
walls AS (
  SELECT entry_id, "start", k,
    timezone('{LOCAL_ZONE}', timezone('UTC', "start" + k * interval 1 hour)) AS wall,
    timezone('{LOCAL_ZONE}', timezone('UTC', "end")) AS last_wall
  FROM (
    SELECT entry_id, "start", "end",
      unnest(range(0, greatest(0, date_diff('hour', "start", "end")) + 4)) AS k
    FROM entries
  )
),
touched AS (
  SELECT *, min(CASE WHEN date_trunc('hour', wall) >= date_trunc('hour', last_wall) THEN k END)
    OVER (PARTITION BY entry_id) AS last
  FROM walls
)"""


def _with(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)}\n{body}"


def _hours(body: str, *more: str, source: str = ENTRIES) -> str:
    return _with(body, source, HOURED, TAGGED, *more)


def _level(level: str) -> str:
    return f"strftime(startdate, '{LEVEL_FORMAT[level]}')"


def _measures(slice_type: str) -> str:
    if "hour" in SLICES[slice_type]:
        return 'CAST(count(*) AS BIGINT) AS "hourCount"'
    if slice_type == "yearSum":
        return 'CAST(sum(duration) AS BIGINT) AS "totalTime"'
    return (
        'CAST(count(DISTINCT CAST(startdate AS DATE)) AS BIGINT) AS "count", '
        'CAST(count(*) AS BIGINT) AS "hourCount"'
    )


def _table(kind: str) -> str:
    return "tagged" if kind == "tag" else "houred"


def _slice(kind: str, slice_type: str) -> str:
    keys = ", ".join(KEYS[kind])
    levels = ", ".join(f'{_level(v)} AS "{v}"' for v in SLICES[slice_type])
    return f"SELECT {keys}, {levels}, {_measures(slice_type)} FROM {_table(kind)} GROUP BY ALL"


def _all_slices(kind: str) -> str:
    keys = ", ".join(KEYS[kind])
    parts = []
    for slice_type, levels in SLICES.items():
        columns = [
            f'{_level(v)} AS "{v}"' if v in levels else f'CAST(NULL AS VARCHAR) AS "{v}"'
            for v in LEVEL_FORMAT
        ]
        struct = "hour" not in levels and slice_type != "yearSum"
        days = "count(DISTINCT CAST(startdate AS DATE))" if struct else "0"
        parts.append(
            f"SELECT '{slice_type}' AS \"histType\", {keys}, {', '.join(columns)}, "
            f'CAST({days} AS BIGINT) AS "count", CAST(count(*) AS BIGINT) AS "hourCount", '
            f'CAST(sum(duration) AS BIGINT) AS "totalTime" FROM {_table(kind)} GROUP BY ALL'
        )
    return " UNION ALL ".join(parts)


def _hist(kind: str, slice_type: str) -> str:
    """One slice as (keys, hist JSON), folded level by level."""
    keys = ", ".join(KEYS[kind])
    levels = list(SLICES[slice_type])
    if "hour" in levels:
        leaf = 'CAST("hourCount" AS VARCHAR)'
    elif slice_type == "yearSum":
        leaf = 'CAST("totalTime" AS VARCHAR)'
    else:
        leaf = "'{\"count\":' || \"count\" || ',\"hourCount\":' || \"hourCount\" || '}'"
    quoted = ", ".join(f'"{v}"' for v in levels)
    sql = f"SELECT {keys}, {quoted}, {leaf} AS hist FROM ({_slice(kind, slice_type)})"
    while levels:
        inner = levels.pop()
        outer = "".join(f', "{v}"' for v in levels)
        sql = (
            f"SELECT {keys}{outer}, '{{' || string_agg('\"' || \"{inner}\" || '\":' || hist, ',' "
            f'ORDER BY "{inner}") || \'}}\' AS hist FROM ({sql}) GROUP BY ALL'
        )
    return sql


def _all_hists(kind: str) -> str:
    keys = ", ".join(KEYS[kind])
    return " UNION ALL ".join(
        f"SELECT {keys}, '{s}' AS \"histType\", hist FROM ({_hist(kind, s)})" for s in SLICES
    )


def _types(kind: str, joined: bool = True) -> str:
    keys = ", ".join(KEYS[kind])
    agg = "string_agg(tag, ',' ORDER BY tag)" if joined else "list(tag ORDER BY tag)"
    return (
        f"SELECT {keys}, {agg} AS types FROM "
        f"(SELECT DISTINCT {keys}, unnest(types) AS tag FROM entries) GROUP BY ALL"
    )


def _hists_with_types(kind: str) -> str:
    using = ", ".join(KEYS[kind])
    return (
        f'SELECT {using}, types, "histType", hist FROM ({_all_hists(kind)}) '
        f"JOIN ({_types(kind)}) USING ({using})"
    )


TOTALS = """
SELECT 'project' AS "sliceType", project AS "sliceKey",
  CAST(sum(duration) AS BIGINT) AS "totalTime" FROM entries GROUP BY project
UNION ALL
SELECT 'project.description', project || '|' || description,
  CAST(sum(duration) AS BIGINT) FROM entries GROUP BY project, description
UNION ALL
SELECT 'type', tag, CAST(sum(duration) AS BIGINT)
FROM (SELECT unnest(types) AS tag, duration FROM entries) GROUP BY tag"""

# Text of a time value per time type, for the types that count hours.
TIME_FORMATS = {
    "hour": "%H",
    "hourYear": "%Y_%H",
    "hourMonth": "%m_%H",
    "hourMonthYear": "%Y-%m_%H",
    "hourDay": "%w_%H",
    "hourDayYear": "%Y_%w_%H",
    "hourDayMonth": "%m_%w_%H",
    "hourDayMonthYear": "%Y-%m_%w_%H",
    "date": "%Y-%m-%d",
    "day": "%w",
    "dayYear": "%Y_%w",
    "dayMonth": "%m_%w",
    "dayMonthYear": "%Y-%m_%w",
    "month": "%m",
    "monthYear": "%Y-%m",
    "week": "%W_%Y",
}


def _time_totals() -> str:
    parts = [
        f"SELECT '{kind}' AS \"timeType\", strftime(startdate, '{fmt}') AS \"timeValue\", "
        'CAST(count(*) AS BIGINT) AS "totalTime" FROM houred GROUP BY ALL'
        for kind, fmt in TIME_FORMATS.items()
    ]
    parts.append(
        "SELECT 'weekMonth', strftime(startdate, '%m') || '_' || (day(startdate) // 7), "
        "CAST(count(*) AS BIGINT) FROM houred GROUP BY ALL"
    )
    parts.append(
        "SELECT 'year', strftime(\"start\", '%Y'), CAST(sum(duration) AS BIGINT) "
        "FROM entries GROUP BY ALL"
    )
    return " UNION ALL ".join(parts)


TIMES = f"times AS ({_time_totals()})"


def _top(by: str) -> str:
    order = '"timeValue" DESC' if by == "timeValue" else '"totalTime" DESC, "timeValue" DESC'
    return (
        'SELECT "timeType", rnk, "timeValue", "totalTime" FROM (SELECT *, '
        f'CAST(row_number() OVER (PARTITION BY "timeType" ORDER BY {order}) AS INT) AS rnk '
        "FROM times) WHERE rnk <= 3"
    )


BEST_YEAR = f"""
best AS (
  SELECT "timeValue" AS "year", "totalTime" FROM ({_top("timeValue")})
  WHERE "timeType" = 'year' ORDER BY "totalTime" DESC, "timeValue" DESC LIMIT 1
)"""


def _options(slice_type: str, year: str, month: str) -> str:
    given = {"year": year, "month": month}
    tests = [f"\"{v}\" = '{given[v]}'" for v in SLICES[slice_type][:-1]]
    return " WHERE " + " AND ".join(tests) if tests else ""


def _dense(kind: str, slice_type: str, year: str, month: str, count_type: str = "hourCount") -> str:
    """CTEs ending in ``dense``: every series with data, a value for every axis key."""
    keys = ", ".join(KEYS[kind])
    inner = SLICES[slice_type][-1]
    if "hour" in SLICES[slice_type]:
        value = "hourCount"
    else:
        value = "totalTime" if slice_type == "yearSum" else count_type
    # The years are those of the data.
    axis = "SELECT DISTINCT bucket FROM leaves"
    if inner in AXES:
        axis = "VALUES " + ", ".join(f"('{key}')" for key in AXES[inner])
    return f"""
leaves AS (
  SELECT {keys}, "{inner}" AS bucket, "{value}" AS value
  FROM ({_slice(kind, slice_type)}){_options(slice_type, year, month)}
),
axis(bucket) AS ({axis}),
series AS (SELECT DISTINCT {keys} FROM leaves JOIN axis USING (bucket) WHERE value <> 0),
dense AS (
  SELECT {keys}, bucket, coalesce(value, 0) AS value
  FROM (SELECT * FROM series CROSS JOIN axis) LEFT JOIN leaves USING ({keys}, bucket)
)"""


def _kept(kind: str) -> str:
    keys = ", ".join(KEYS[kind])
    return f"""
kept AS (SELECT *, value = max(value) OVER (PARTITION BY bucket) AS won FROM dense),
visible AS (SELECT DISTINCT {keys} FROM kept WHERE won AND value <> 0),
bars AS (
  SELECT {keys}, bucket, CASE WHEN won THEN value ELSE 0 END AS value
  FROM kept JOIN visible USING ({keys})
)"""


def _pick(names: Sequence[str], index: str) -> str:
    return f"({_list(names)})[{index} + 1]"


def _axis_label(inner: str, key: str = "bucket") -> str:
    number = f"CAST({key} AS INT)"
    if inner == "day":
        return _pick(WEEKDAY_NAMES, number)
    if inner == "month":
        return f"substr({_pick(MONTH_NAMES, number + ' - 1')}, 1, 3)"
    if inner == "hour":
        return (
            f"CASE WHEN {number} % 12 = 0 THEN '12' ELSE CAST({number} % 12 AS VARCHAR) END || "
            f"CASE WHEN {number} < 12 THEN 'am' ELSE 'pm' END"
        )
    return key


def _unit(n: str, unit: str) -> str:
    return f"CASE WHEN {n} = 1 THEN '1 {unit}' WHEN {n} <> 0 THEN {n} || ' {unit}s' END"


def _duration(value: str) -> str:
    days, hours = f"({value} // 86400)", f"({value} % 86400 // 3600)"
    return f"nullif(concat_ws(' ', {_unit(days, 'day')}, {_unit(hours, 'hour')}), '')"


def _page(kind: str, slice_type: str, source: str | None = None) -> str:
    year, month = (GROUP_YEAR, GROUP_MONTH) if kind == "group" else (TAG_YEAR, TAG_MONTH)
    keys = ", ".join(KEYS[kind])
    name = "project || ' - ' || description" if kind == "group" else "tag"
    shown = (
        _duration("value")
        if slice_type == "yearSum"
        else "CASE WHEN value <> 0 THEN CAST(value AS VARCHAR) END"
    )
    return _hours(
        f"SELECT {keys}, {name} AS name, bucket, {_axis_label(SLICES[slice_type][-1])} AS label, "
        f"value, {shown} AS value_label FROM bars",
        _dense(kind, slice_type, year, month),
        _kept(kind),
        source=source or ENTRIES,
    )


def _ordinal(n: str) -> str:
    return (
        f"({n} || CASE WHEN {n} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' "
        f"WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END)"
    )


def _hour_name(n: str) -> str:
    return (
        f"CASE WHEN {n} = 0 THEN '12 midnight' WHEN {n} = 12 THEN '12 noon' "
        f"WHEN {n} < 12 THEN {n} || ' am' ELSE ({n} - 12) || ' pm' END"
    )


def _time_label(compat: bool) -> str:
    def part(sep: str, i: int) -> str:
        return f"TRY_CAST(split_part(\"timeValue\", '{sep}', {i}) AS INT)"

    def weekday(n: str) -> str:
        return _pick(WEEKDAY_NAMES, f"({n} + 1) % 7" if compat else n)

    def month(n: str) -> str:
        return _pick(MONTH_NAMES, f"({n} % 12)" if compat else f"({n} - 1)")

    date = 'TRY_CAST("timeValue" AS DATE)'
    week, year = part("_", 1), part("_", 2)
    if compat:
        # Sunday-first week number of January 1st plus the given weeks.
        day = f"(make_date({year}, 1, 1) + {week} * 7)"
        sunday = f"({day} - CAST(dayofweek({day}) AS INT))"
        january = f"make_date(CAST(year({sunday} + 6) AS INT), 1, 1)"
        first = f"({january} - CAST(dayofweek({january}) AS INT))"
        number = f"(({sunday} - {first}) // 7 + 1)"
    else:
        number = f"({week} + 1)"
    return f"""CASE "timeType"
  WHEN 'hour' THEN {_hour_name(part('_', 1))}
  WHEN 'hourDay' THEN {weekday(part('_', 1))} || 's at ' || {_hour_name(part('_', 2))}
  WHEN 'date' THEN strftime({date}, '%A, %B ') || {_ordinal(f'day({date})')} || ', ' || year({date})
  WHEN 'day' THEN {weekday(part('_', 1))}
  WHEN 'week' THEN {_ordinal(number)} || ' week of ' || split_part("timeValue", '_', 2)
  WHEN 'weekMonth' THEN {_ordinal(f"({part('_', 2)} + 1)")} || ' week of ' || {month(part('_', 1))} || 's'
  WHEN 'month' THEN {month(part('_', 1))}
  WHEN 'monthYear' THEN {month(part('-', 2))} || ' in ' || split_part("timeValue", '-', 1)
  ELSE "timeValue" END"""


def _names(*known: str) -> str:
    """Project and description as columns, null where a section has none."""
    return ", ".join(
        name if name in known else f"CAST(NULL AS VARCHAR) AS {name}" for name in ("project", "description")
    )


def _document_times(section: str) -> str:
    source, order = "times", '"timeValue"'
    if section == "byTime.top":
        source, order = f"({_top('timeValue')})", '"totalTime" DESC, "timeValue"'
    item = (
        "'{\"totalTime\":' || \"totalTime\" || ',\"timeString\":\"' || label || "
        "'\",\"originalTime\":\"' || \"timeValue\" || '\"}'"
    )
    return (
        f"SELECT '{section}' AS section, \"timeType\" AS entity, {_names()}, "
        f"'[' || string_agg({item}, ',' ORDER BY {order}) || ']' AS json "
        f"FROM (SELECT *, {_time_label(False)} AS label FROM {source}) GROUP BY \"timeType\""
    )


def _members(kind: str) -> str:
    keys = ", ".join(KEYS[kind])
    return (
        f"SELECT {keys}, string_agg('\"' || \"histType\" || '\":' || hist, ',' "
        f'ORDER BY "histType") AS members FROM ({_all_hists(kind)}) GROUP BY ALL'
    )


def _document_tags() -> str:
    return (
        f"SELECT 'byType.all' AS section, tag AS entity, {_names()}, '{{' || members || '}}' AS json "
        f"FROM ({_members('tag')})"
    )


def _document_entities(kind: str, section: str) -> str:
    keys = KEYS[kind]
    named = " || ',' || ".join(f"'\"{k}\":' || to_json({k})" for k in keys)
    entity = " || '|' || ".join(keys)
    using = ", ".join(keys)
    return (
        f"SELECT '{section}' AS section, {entity} AS entity, {_names(*keys)}, "
        f"'{{' || {named} || ',\"type\":' || to_json(types) || ',' || members || '}}' AS json "
        f"FROM ({_members(kind)}) JOIN ({_types(kind, joined=False)}) USING ({using})"
    )


DOCUMENT_TOTALS = f"""
SELECT 'byProject.totals' AS section, project AS entity, {_names("project")},
  CAST(CAST(sum(duration) AS BIGINT) AS VARCHAR) AS json FROM entries GROUP BY project
UNION ALL
SELECT 'byGroup.totals', project || '|' || description, project, description,
  CAST(CAST(sum(duration) AS BIGINT) AS VARCHAR) FROM entries GROUP BY project, description
UNION ALL
SELECT 'byType.totals', tag, {_names()}, CAST(CAST(sum(duration) AS BIGINT) AS VARCHAR)
FROM (SELECT unnest(types) AS tag, duration FROM entries) GROUP BY tag"""

HEATMAP = """
calendar AS (
  SELECT first, CAST(unnest(generate_series(
      first - CAST(dayofweek(first) AS INT),
      last + (6 - CAST(dayofweek(last) AS INT)), interval 1 day)) AS DATE) AS date
  FROM periods
),
heatmap AS (
  SELECT first, date, date - CAST(dayofweek(date) AS INT) AS week_start,
    CAST(dayofweek(date) AS INT) AS dow, coalesce(t."totalTime", 0) AS hours
  FROM calendar LEFT JOIN times t
    ON t."timeType" = 'date' AND t."timeValue" = strftime(date, '%Y-%m-%d')
),
topped AS (SELECT *, max(hours) OVER (PARTITION BY first) AS largest FROM heatmap),
binned AS (
  SELECT *, CASE WHEN hours = 0 THEN 0
    WHEN hours <= ceil(largest * 0.25) THEN 1
    WHEN hours <= ceil(largest * 0.5) THEN 2
    WHEN hours <= ceil(largest * 0.75) THEN 3 ELSE 4 END AS bin
  FROM topped
)"""

FIXED_PERIOD = "periods AS (SELECT DATE '1999-01-01' AS first, DATE '1999-12-31' AS last)"
HOURS_LABEL = (
    "CASE WHEN hours = 0 THEN 'N/A' WHEN hours = 1 THEN '1 hour' ELSE hours || ' hours' END"
)


def _periods(years: str) -> str:
    return (
        "periods AS (SELECT make_date(CAST(y AS INT), 1, 1) AS first, "
        f"make_date(CAST(y AS INT), 12, 31) AS last FROM ({years}))"
    )


GROUPS = """
groups AS (
  SELECT project, description, CAST(sum(duration) AS BIGINT) AS total
  FROM entries GROUP BY ALL
)"""

HIERARCHY = """
SELECT CAST(2 - grouping(project) - grouping(description) AS INT) AS depth, project, description,
  CAST(sum(total) AS BIGINT) AS total
FROM groups GROUP BY ROLLUP (project, description)"""


def _extents(extent: float) -> str:
    """Shares divided level by level, each child inside its parent's interval."""
    return _with(
        f"""
SELECT 0 AS depth, CAST(NULL AS VARCHAR) AS project, CAST(NULL AS VARCHAR) AS description,
  total, 0.0::DOUBLE AS x0, round({extent!r}::DOUBLE, 9) AS x1 FROM root
UNION ALL
SELECT 1, project, NULL, total, round(x0, 9), round(x1, 9) FROM outer_ring
UNION ALL
SELECT 2, project, description, total, round(x0, 9), round(x1, 9) FROM inner_ring""",
        ENTRIES,
        GROUPS,
        "root AS (SELECT CAST(sum(total) AS BIGINT) AS total FROM groups)",
        f"""
projects AS (SELECT project, CAST(sum(total) AS BIGINT) AS total FROM groups GROUP BY ALL),
outer_ring AS (
  SELECT project, total, {extent!r}::DOUBLE * (ends - total) / whole AS x0,
    {extent!r}::DOUBLE * ends / whole AS x1
  FROM (SELECT *, sum(total) OVER (ORDER BY total DESC, project
      ROWS UNBOUNDED PRECEDING) AS ends, sum(total) OVER () AS whole FROM projects)
),
inner_ring AS (
  SELECT g.project, g.description, g.total,
    o.x0 + (o.x1 - o.x0) * (ends - g.total) / o.total AS x0,
    o.x0 + (o.x1 - o.x0) * ends / o.total AS x1
  FROM (SELECT *, sum(total) OVER (PARTITION BY project ORDER BY total DESC, description
      ROWS UNBOUNDED PRECEDING) AS ends FROM groups) g
  JOIN outer_ring o USING (project)
)""",
    )


ENTRY_OUTPUT = 'project, description, CAST(billable AS INT) AS billable, "start", "end", duration'
ENTRY_TABLE = (
    "SELECT project, description, array_to_string(types, ',') AS tags, "
    'CAST(billable AS INT) AS billable, "start", "end", duration FROM entries'
)
HOUR_ROWS = "SELECT entry_id, CAST(k AS BIGINT) AS k, startdate FROM houred"


LEVEL_COLUMNS = '"histType", "year", "month", "day", "hour"'


def _violations(source: str, seeded: bool = False) -> str:
    """All checks over the three slice tables, with a fault for each if ``seeded``."""
    known = ", ".join(_text(tag) for tag in TAGS)
    rows = {kind: f"SELECT {', '.join(KEYS[kind])}, {LEVEL_COLUMNS} FROM ({_all_slices(kind)})" for kind in KEYS}
    stray = ""
    if seeded:
        project, year_sum = rows["project"], "\"histType\" = 'yearSum'"
        rows["project"] = f"{project} UNION ALL SELECT * FROM ({project}) WHERE project = 'Class' AND {year_sum}"
        rows["group"] = f"SELECT * REPLACE (CASE WHEN project <> 'Scuba' THEN description END AS description) FROM ({rows['group']})"
        rows["tag"] = (
            "SELECT * REPLACE (CASE WHEN tag = 'Fun' THEN 'Leisure' ELSE tag END AS tag) "
            f"FROM ({rows['tag']}) WHERE NOT (tag = 'Dogs' AND {year_sum})"
        )
        stray = "UNION ALL SELECT 'stray column in projects', 'description', ''"

    def keyed(kind: str, table: str) -> str:
        keys = ", ".join(KEYS[kind])
        lost = " ".join(
            f"UNION ALL SELECT DISTINCT 'no {name} in {table}', '{name}', 'null' FROM {kind}_rows WHERE {name} IS NULL"
            for name in KEYS[kind]
        )
        return f"""
SELECT 'repeated key in {table}' AS "check", concat_ws('|', {keys}, {LEVEL_COLUMNS}) AS "key",
  CAST(count(*) AS VARCHAR) AS detail
FROM {kind}_rows GROUP BY {keys}, {LEVEL_COLUMNS} HAVING count(*) > 1 {lost}"""

    return _hours(
        f"""
{keyed("project", "projects")} UNION ALL {keyed("group", "groups")} UNION ALL {keyed("tag", "tags")}
UNION ALL
SELECT 'unknown tag', tag, '' FROM (SELECT DISTINCT tag FROM tag_rows) WHERE tag NOT IN ({known})
UNION ALL
SELECT 'missing slices', tag, CAST(count(DISTINCT "histType") AS VARCHAR)
FROM tag_rows GROUP BY tag HAVING count(DISTINCT "histType") < 16 {stray}""",
        *[f"{kind}_rows AS ({sql})" for kind, sql in rows.items()],
        source=source,
    )


def _own_rules() -> str:
    tests = [
        f"CASE WHEN regexp_matches({column}, {_text('(?i)' + pattern)}) THEN {_text(tag)} END"
        for column, found in (("project", OWN_RULES.project_tags), ("description", OWN_RULES.description_tags))
        for tag, pattern in found
    ]
    return f"""
SELECT doc_id, CASE WHEN len(tags) = 0 THEN {_text(OWN_RULES.no_tag)} ELSE array_to_string(tags, ',') END AS tags,
  CAST(0 AS INT) AS billable, CAST(5400 AS BIGINT) AS duration
FROM (
  SELECT doc_id, list_filter([{", ".join(tests)}], lambda t: t IS NOT NULL) AS tags
  FROM (SELECT doc_id, source AS project, regexp_replace(text, '\\s+', ' ', 'g') AS description FROM documents)
)"""


ROW_COUNTS = f"""
SELECT 'raw' AS "table", CAST(count(*) AS BIGINT) AS "rows" FROM entries
UNION ALL SELECT 'houred', CAST(count(*) AS BIGINT) FROM houred
UNION ALL SELECT 'totals', CAST(count(*) AS BIGINT) FROM ({TOTALS})
UNION ALL SELECT 'totalsTime', CAST(count(*) AS BIGINT) FROM times"""


def oracle_sql() -> dict[str, str]:
    document = " UNION ALL ".join(
        (
            f"SELECT section, entity, project, description, json FROM ({part})"
            for part in (
                _document_times("byTime.top"),
                _document_times("byTime.all"),
                _document_tags(),
                _document_entities("group", "byGroup.all"),
                _document_entities("project", "byProject.all"),
                DOCUMENT_TOTALS,
            )
        )
    )
    sql = {
        "clean_entries": _with(f"SELECT entry_id, {ENTRY_OUTPUT} FROM cleaned", RAW),
        "tag_entries": _with(
            "SELECT entry_id, array_to_string(types, ',') AS tags FROM entries", ENTRIES
        ),
        "tag_documents": _with(
            "SELECT doc_id, array_to_string(types, ',') AS tags FROM documents d "
            "JOIN pair_tags p ON p.project = d.source AND p.description = d.text",
            RULES,
            _tagging("documents", "source", "text"),
        ),
        "tag_documents_own_rules": _own_rules(),
        "tag_documents_many_rules": f"""SELECT doc_id, coalesce(nullif(array_to_string(list_transform(
  list_filter({_list(SYLLABLES)}, lambda w: contains(lower(text), w)), lambda w: 'has ' || w), ','), ''), 'NONE') AS tags
FROM documents""",
        "text_forms": _with(
            "SELECT entry_id, CAST(to_json(types) AS VARCHAR) AS tags_json, "
            "CAST(len(types) AS BIGINT) AS tag_count, "
            "strftime(\"start\", '%Y-%m-%dT%H:%M:%SZ') AS start_iso, "
            "strftime(\"end\", '%Y-%m-%dT%H:%M:%SZ') AS end_iso FROM entries",
            ENTRIES,
        ),
        "csv_roundtrip": _with(ENTRY_TABLE, ENTRIES),
        "entry_table": _with(ENTRY_TABLE, ENTRIES),
        "hour_fanout": _with(HOUR_ROWS, ENTRIES, HOURED),
        "hour_fanout_events": _with(HOUR_ROWS, EVENTS, HOURED),
        "hour_fanout_local": _with(
            "SELECT entry_id, k, wall AS startdate FROM touched WHERE k <= last", ENTRIES, LOCAL_HOURS
        ),
        "explode_tags": _with("SELECT entry_id, unnest(types) AS tag FROM entries", ENTRIES),
        "distinct_tags_group": _with(_types("group"), ENTRIES),
        "distinct_tags_project": _with(_types("project"), ENTRIES),
        "totals": _with(TOTALS, ENTRIES),
        "grown_totals": _with(TOTALS, ENTRIES),
        "grown_time_totals": _hours("SELECT * FROM times", TIMES),
        "split_totals": _with(
            'SELECT project, description, total AS "totalTime" FROM groups', ENTRIES, GROUPS
        ),
        "time_totals": _hours("SELECT * FROM times", TIMES),
        "time_totals_events": _hours("SELECT * FROM times", TIMES, source=EVENTS),
        "rollup_tables": _hours(_hists_with_types("group")),
        "document_files": _hours(document, TIMES),
        "top_latest_per_type": _hours(_top("timeValue"), TIMES),
        "top_total_per_type": _hours(_top("totalTime"), TIMES),
        "best_recent_year": _hours("SELECT * FROM best", TIMES, BEST_YEAR),
        "winner_per_bucket": _hours(
            "SELECT project, bucket, value FROM kept WHERE won",
            _dense("project", "hourCount", "", ""),
            _kept("project"),
        ),
        "winner_series_filled": _hours(
            "SELECT project, bucket, value FROM bars",
            _dense("project", "hourCount", "", ""),
            _kept("project"),
        ),
        "max_over_series": _hours(
            "SELECT CAST(max(value) AS BIGINT) AS largest FROM dense",
            _dense("group", "dayCount", "", ""),
        ),
        "calendar_heatmap": _hours(
            f"SELECT date, week_start, dow, hours, {HOURS_LABEL} AS label FROM heatmap",
            TIMES,
            FIXED_PERIOD,
            HEATMAP,
        ),
        "intensity_bins": _hours(
            "SELECT date, hours, largest, bin FROM binned", TIMES, FIXED_PERIOD, HEATMAP
        ),
        "heatmap_all_years": _hours(
            "SELECT CAST(year(first) AS INT) AS \"year\", date, hours, bin FROM binned",
            TIMES,
            _periods("SELECT \"timeValue\" AS y FROM times WHERE \"timeType\" = 'year'"),
            HEATMAP,
        ),
        "hierarchy_sum": _with(HIERARCHY, ENTRIES, GROUPS),
        "share_extents": _extents(1.0),
        "time_labels": _hours(
            f'SELECT "timeType", "timeValue", {_time_label(False)} AS "timeString" FROM times', TIMES
        ),
        "time_labels_compat": _hours(
            f'SELECT "timeType", "timeValue", {_time_label(True)} AS "timeString" FROM times', TIMES
        ),
        "value_labels": _with(
            f"SELECT project, description, {_duration('total')} AS duration_label, "
            "CASE WHEN total <> 0 THEN CAST(total AS VARCHAR) END AS count_label FROM groups",
            ENTRIES,
            GROUPS,
        ),
        "document_by_time_top": _hours(_document_times("byTime.top"), TIMES),
        "document_by_time_all": _hours(_document_times("byTime.all"), TIMES),
        "document_by_type": _hours(_document_tags()),
        "document_by_group": _hours(_document_entities("group", "byGroup.all")),
        "document_by_project": _hours(_document_entities("project", "byProject.all")),
        "document_totals": _with(DOCUMENT_TOTALS, ENTRIES),
        "quality_violations": _violations(ENTRIES),
        "quality_violations_events": _violations(EVENTS),
        "quality_violations_seeded": _violations(ENTRIES, seeded=True),
        "row_counts": _hours(ROW_COUNTS, TIMES),
        "written_counts": "SELECT count(*) AS written, count(*) AS found, true AS same_content FROM orders",
        "written_faults": """SELECT "table", count(*) AS rows, true AS same_rows, "table" = 'sound' AS same_content
FROM orders, (VALUES ('sound'), ('damaged')) AS cases("table") GROUP BY "table" """,
        "grown_documents": _hours(_hists_with_types("group")),
        "page_live_g3_group": _page("group", "dayMonthYearCount"),
        "page_live_tag_events": _page("tag", "dayCount", EVENTS),
        "page_g8_heatmap": _hours(
            f"SELECT date, week_start, dow, hours, bin, {HOURS_LABEL} AS label FROM binned",
            TIMES,
            BEST_YEAR,
            _periods('SELECT "year" AS y FROM best'),
            HEATMAP,
        ),
        "page_g9_sunburst": _extents(2 * math.pi),
    }
    for kind in KEYS:
        for name in ("all_slices", "stored_slices", "grown_slices"):
            sql[f"{name}_{kind}"] = _hours(_all_slices(kind))
        sql[f"hist_json_{kind}"] = _hours(
            _all_hists(kind) if kind == "tag" else _hists_with_types(kind)
        )
        for slice_type in SLICES:
            sql[f"hist_{kind}_{slice_type}"] = _hours(_slice(kind, slice_type))
    for slice_type in NESTED_SLICES:
        sql[f"nested_maps_{slice_type}"] = _hours(_hist("project", slice_type))
    for slice_type in EVENT_SLICES:
        sql[f"events_hist_group_{slice_type}"] = _hours(_slice("group", slice_type), source=EVENTS)
    for slice_type in CHART_SLICES:
        for kind in KEYS:
            sql[f"series_{kind}_{slice_type}"] = _series(slice_type, kind=kind)
    sql["series_project_dayCount_dates"] = _series("dayCount", "count")
    sql["series_project_hourCount_converted"] = _series("hourCount", value="value * 60 + 1")
    for page, slice_type in PAGES.items():
        for kind in ("group", "tag"):
            sql[f"page_{page}_{kind}"] = _page(kind, slice_type)
    return sql


def _series(
    slice_type: str, count_type: str = "hourCount", kind: str = "project", value: str = "value"
) -> str:
    label = _axis_label(SLICES[slice_type][-1])
    keys = ", ".join(KEYS[kind])
    if kind == "tag":
        keys += f", CAST(list_position({_list(TAGS)}, tag) AS BIGINT) AS tag_order"
    return _hours(
        f"SELECT {keys}, bucket, {label} AS label, {value} AS value FROM dense",
        _dense(kind, slice_type, GROUP_YEAR, GROUP_MONTH, count_type),
    )
