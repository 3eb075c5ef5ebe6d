"""Fixed values.

Everything in this module is data that decides results: names of slices and
time types, key domains, tag rules, cleaning entries, CSV columns and date
formats. They are stated here once, as plain text, and used everywhere else.
"""

from __future__ import annotations

# The closed name lists.
TIME_TYPES = (
    "hour",
    "hourYear",
    "hourMonth",
    "hourMonthYear",
    "hourDay",
    "hourDayYear",
    "hourDayMonth",
    "hourDayMonthYear",
    "date",
    "day",
    "dayYear",
    "dayMonth",
    "dayMonthYear",
    "month",
    "monthYear",
    "week",
    "weekMonth",
    "year",
)

TAGS = (
    "Apply",
    "Beyond",
    "Community",
    "Compost",
    "Dogs",
    "Email",
    "Exercise",
    "Fun",
    "Hustle",
    "Meeting",
    "Networking",
    "New",
    "PNNL",
    "Paid",
    "Research",
    "Resume",
    "Scholarship",
    "School",
    "UNKNOWN",
    "Work",
)

NO_TAG = "UNKNOWN"

TOTAL_TYPES = ("project", "project.description", "type")

# Every histogram slice with its levels, outermost first.
SLICES = {
    "hourCount": ("hour",),
    "hourDayCount": ("day", "hour"),
    "hourMonthCount": ("month", "hour"),
    "hourYearCount": ("year", "hour"),
    "hourDayMonthCount": ("month", "day", "hour"),
    "hourDayYearCount": ("year", "day", "hour"),
    "hourMonthYearCount": ("year", "month", "hour"),
    "hourDayMonthYearCount": ("year", "month", "day", "hour"),
    "dayCount": ("day",),
    "dayYearCount": ("year", "day"),
    "dayMonthCount": ("month", "day"),
    "dayMonthYearCount": ("year", "month", "day"),
    "monthCount": ("month",),
    "monthYearCount": ("year", "month"),
    "yearCount": ("year",),
    "yearSum": ("year",),
}

# The slices a chart can show (the others have no selector).
CHART_SLICES = (
    "hourCount",
    "hourYearCount",
    "hourMonthCount",
    "hourMonthYearCount",
    "dayCount",
    "dayYearCount",
    "dayMonthCount",
    "dayMonthYearCount",
    "monthCount",
    "monthYearCount",
    "yearCount",
    "yearSum",
)

# Key domains of the chart axes. Years are only a default.
HOURS = tuple(f"{h:02d}" for h in range(24))
DAYS = tuple(str(d) for d in range(7))
MONTHS = tuple(f"{m:02d}" for m in range(1, 13))
YEARS = ("2021", "2022", "2023", "2024")

# The columns of a time-entry export, in file order.
CSV_COLUMNS = (
    "User",
    "Email",
    "Client",
    "Project",
    "Task",
    "Description",
    "Billable",
    "Start date",
    "Start time",
    "End date",
    "End time",
    "Duration",
    "Tags",
)

# Date patterns of the export and of the ISO text form.
CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ssXXX"

# Tag rules, tested in this order, case-insensitive, unanchored.
PROJECT_TAG_RULES = (
    ("Hustle", r"leht"),
    ("Beyond", r"refactor|kitchen"),
    ("Community", r"refactor"),
    ("Fun", r"exercise|scuba|motorcycle|avalanche"),
    ("Exercise", r"exercise"),
    ("New", r"scuba|motorcycle|avalanche"),
    ("Dogs", r"dog"),
    ("Paid", r"innovation|teaching assistant|hopped|pika"),
    ("School", r"\d{3}|^class\z"),
    ("Scholarship", r"scholarship"),
    ("Compost", r"capstone|compost"),
)

DESCRIPTION_TAG_RULES = (
    ("Apply", r"apply|application"),
    ("Meeting", r"meet"),
    ("Networking", r"network|attend"),
    ("Resume", r"resume"),
    ("Research", r"research"),
    ("Community", r"trio|sacnas"),
    ("Scholarship", r"ford|scholarship"),
    ("Beyond", r"gift card|recommendation|thank you"),
    ("Work", r"work|code|interview"),
    ("Email", r"email|letter"),
    ("Compost", r"compost"),
    ("Dogs", r"dog"),
    ("New", r"skin"),
    ("Exercise", r"exercise"),
    ("PNNL", r"pnnl|apartment"),
)

# Fixed values: (project, description) -> description used instead.
DESCRIPTION_FIXES = (
    ("Get Hired at Dream Job", "Prepare for SACNAS", "Prepare for SACNAS - Network"),
    ("Get Hired at Dream Job", "Search for housing", "Search for apartment"),
    ("CS 461 Capstone", "Homwork", "Homework"),
)

# Entries without a project but with this description belong to
# the project of the same name.
DEFAULT_PROJECT = "Exercise"

# Names used by the labels.
WEEKDAY_NAMES = (
    "Sunday",
    "Monday",
    "Tuesday",
    "Wednesday",
    "Thursday",
    "Friday",
    "Saturday",
)

MONTH_NAMES = (
    "January",
    "February",
    "March",
    "April",
    "May",
    "June",
    "July",
    "August",
    "September",
    "October",
    "November",
    "December",
)
