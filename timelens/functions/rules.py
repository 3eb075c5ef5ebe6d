"""Cleaning and tagging of entries, as column expressions over rule lists."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from timelens.fixed_values import (
    DEFAULT_PROJECT,
    DESCRIPTION_FIXES,
    DESCRIPTION_TAG_RULES,
    NO_TAG,
    PROJECT_TAG_RULES,
)
from timelens.functions.rule_index import INDEXED_FROM, constant_texts, pair_lookup, words_found


class Rules(NamedTuple):
    """A rule set: how entries are cleaned and tagged. The default is the library's own."""

    default_project: str = DEFAULT_PROJECT
    fixes: Sequence[tuple[str, str, str]] = DESCRIPTION_FIXES
    project_tags: Sequence[tuple[str, str]] = PROJECT_TAG_RULES
    description_tags: Sequence[tuple[str, str]] = DESCRIPTION_TAG_RULES
    no_tag: str = NO_TAG


def default_project(project: Column, description: Column, name: str = DEFAULT_PROJECT) -> Column:
    """An empty project becomes ``name`` when the description is exactly ``name``."""
    return F.when((project == "") & (description == name), F.lit(name)).otherwise(project)


def clean_description(
    project: Column,
    description: Column,
    fixes: Sequence[tuple[str, str, str]] = DESCRIPTION_FIXES,
) -> Column:
    """Replace the description of exactly matching (project, description) pairs.

    The rule list is configuration, so it stays an expression: no join. The first of
    several rules for a pair counts. A long list becomes a table that is looked up.
    """
    if len(fixes) >= INDEXED_FROM:
        return F.coalesce(pair_lookup(project, description, fixes), description)
    fixed = None
    for rule_project, rule_description, replacement in fixes:
        hit = (project == rule_project) & (description == rule_description)
        fixed = F.when(hit, replacement) if fixed is None else fixed.when(hit, replacement)
    return description if fixed is None else fixed.otherwise(description)


def billable_flag(billable: Column) -> Column:
    return F.when(billable == "No", 0).otherwise(1)


# Letters outside ASCII whose lower case contains an ASCII letter.
_FALSE_LOWER = ("\u0130", "\u212a")


def folded(text: Column) -> Column:
    """Lower case in which ASCII letters come from ASCII letters only."""
    for letter in _FALSE_LOWER:
        text = F.replace(text, F.lit(letter), F.lit("\x00"))
    return F.lower(text)


def _is_plain(pattern: str) -> bool:
    """Alternatives of plain words, which need no regular expression."""
    return re.fullmatch(r"[a-z0-9 |]+", pattern) is not None


def _matches(text: Column, low: Column, pattern: str) -> Column:
    """Case-insensitive test of one pattern."""
    if not _is_plain(pattern):
        return text.rlike(f"(?i){pattern}")
    found = None
    for word in pattern.split("|"):
        hit = low.contains(word)
        found = hit if found is None else found | hit
    return found


def _indexed_tags(tested: Sequence[tuple[tuple[Column, Column], tuple[str, str]]]) -> Column:
    """The same tags from tables of words, one for each text; other patterns by themselves."""
    found, by_text = [], {}
    for number, (text, (_, pattern)) in enumerate(tested):
        if _is_plain(pattern):
            words = by_text.setdefault(id(text), (text, []))[1]
            words += [(word, number) for word in pattern.split("|")]
        else:
            found.append(F.when(_matches(*text, pattern), F.lit(number)))
    hits = [words_found(low, words) for (_, low), words in by_text.values()]
    if found:
        hits.append(F.array_compact(F.array(*found)))
    names = constant_texts([tag for _, (tag, _) in tested])
    return F.array_distinct(F.transform(F.array_sort(F.concat(*hits)), lambda n: F.get(names, n)))


def matching_tags(
    project: tuple[Column, Column],
    description: tuple[Column, Column],
    project_rules: Sequence[tuple[str, str]] = PROJECT_TAG_RULES,
    description_rules: Sequence[tuple[str, str]] = DESCRIPTION_TAG_RULES,
) -> Column:
    """Tags of all matching rules in rule order, each once; empty if none match.

    Both texts come with their folded form. Long lists are looked up in tables.
    """
    tested = [(project, rule) for rule in project_rules]
    tested += [(description, rule) for rule in description_rules]
    if len(tested) >= INDEXED_FROM:
        return _indexed_tags(tested)
    hits = [F.when(_matches(*text, pattern), F.lit(tag)) for text, (tag, pattern) in tested]
    if not hits:
        return F.array().cast("array<string>")
    return F.array_except(F.array(*hits), F.array(F.lit(None).cast("string")))


def or_no_tag(tags: Column, no_tag: str = NO_TAG) -> Column:
    return F.when(F.size(tags) == 0, F.array(F.lit(no_tag))).otherwise(tags)
