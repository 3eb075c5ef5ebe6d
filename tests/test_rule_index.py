"""Long rule lists give what the same rules give one by one."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from timelens.functions import rules
from timelens.functions.rule_index import constant_texts, pair_lookup, words_found
from timelens.functions.rules import Rules, clean_description, folded, matching_tags
from timelens.operators.entries import clean_entries, tag_entries

ODD = ["", "it's", 'say "hi"', "back\\slash", "naïve café", "日本", "😀 smile", "a%b_c", "tab\there", "line\nend", "1:a"]


def random_rules(seed, n=2000):
    rng = random.Random(seed)
    letters = "abcdefg "
    word = lambda a, b: "".join(rng.choice(letters) for _ in range(rng.randrange(a, b)))
    project, description = [], []
    for i in range(n):
        pattern = "|".join(word(1, 9) for _ in range(rng.randrange(1, 4)))
        if i % 50 == 0:
            pattern = rng.choice([r"^abc", r"g\d$", "a.c", "(ab|cd)e"])
        (project if i % 3 else description).append((f"T{rng.randrange(300)}", pattern))
    return project, description


def random_texts(seed, n=200):
    rng = random.Random(seed)
    made = ["".join(rng.choice("abcdefgABC 1İK") for _ in range(rng.randrange(0, 40))) for _ in range(n)]
    return made + ODD + [None, "", "ab", "a"]


def by_hand(text, low, patterns):
    """Numbers of the rules that match one text."""
    found = set()
    if text is None:
        return found
    for number, pattern in patterns:
        if re.fullmatch("[a-z0-9 |]+", pattern):
            if any(word in low for word in pattern.split("|")):
                found.add(number)
        elif re.search(pattern, text, re.IGNORECASE | re.ASCII):
            found.add(number)
    return found


def test_two_thousand_tag_rules(spark):
    project_rules, description_rules = random_rules(1)
    rng = random.Random(2)
    projects, descriptions = random_texts(3), random_texts(4)
    rows = [(i, rng.choice(projects), d) for i, d in enumerate(descriptions)]
    made = spark.createDataFrame(rows, "id int, project string, description string").withColumns(
        {"p": folded(F.col("project")), "d": folded(F.col("description"))}
    )
    tags = matching_tags((F.col("project"), F.col("p")), (F.col("description"), F.col("d")), project_rules, description_rules)
    names = [tag for tag, _ in project_rules + description_rules]
    numbered = list(enumerate(p for _, p in project_rules)), list(enumerate((p for _, p in description_rules), len(project_rules)))
    several = 0
    for row in made.withColumn("tags", tags).collect():
        numbers = by_hand(row.project, row.p, numbered[0]) | by_hand(row.description, row.d, numbered[1])
        wanted = list(dict.fromkeys(names[n] for n in sorted(numbers)))
        assert row.tags == wanted, row
        several += len(wanted) > 3
    assert several > 50


def test_tables_equal_the_rules_one_by_one(spark, monkeypatch):
    """The library's own rules, and a hundred of them, through both forms."""
    texts = ["Walk the dog", "CS 461 Capstone", "meeting with Paid Research", "compost & school", None, "", "E-MAIL email"]
    rows = [(p, d, "Yes") for p in texts for d in texts]
    made = spark.createDataFrame(rows, "project string, description string, billable string")
    one_by_one = [tuple(r) for r in tag_entries(clean_entries(made)).collect()]
    monkeypatch.setattr(rules, "INDEXED_FROM", 1)
    assert [tuple(r) for r in tag_entries(clean_entries(made)).collect()] == one_by_one
    assert any(len(r[-1]) > 1 for r in one_by_one)


def test_two_thousand_fixes(spark):
    rng = random.Random(5)
    names = ODD + [f"name {i}" for i in range(300)]
    fixes = [(rng.choice(names), rng.choice(names), f"fixed {i} {rng.choice(ODD)}") for i in range(2000)]
    first = {}
    for p, d, fixed in fixes:
        first.setdefault((p, d), fixed)
    pairs = [*list(first)[:300], *((rng.choice(names), rng.choice(names)) for _ in range(300)), (None, "it's"), ("", None), ("1", ":a")]
    made = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, project string, description string")
    found = made.select("id", clean_description(F.col("project"), F.col("description"), fixes).alias("fixed"))
    assert {r.id: r.fixed for r in found.collect()} == {i: first.get(p, p[1]) for i, p in enumerate(pairs)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE" not in plan and "named_struct" not in plan  # one constant, not an expression a rule


def test_pairs_do_not_run_into_each_other(spark):
    made = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("", "abc"), ("abc", "")], "p string, d string")
    found = made.select("p", pair_lookup(F.col("p"), F.col("d"), [("a", "bc", "x"), ("a", "bc", "later")]).alias("r"))
    assert {r.p: r.r for r in found.collect()} == {"ab": None, "a": "x", "": None, "abc": None}


@pytest.mark.parametrize("words", [[], [("a", 1)], [("abcd", 2), ("bcd", 3), ("", 4), ("bc", 5)]])
def test_words_anywhere(spark, words):
    texts = ["xxabcdxx", "bcd", "ab", "", None, "abcabcd"]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words_found(F.col("t"), words).alias("n"))
    for row in made.collect():
        assert set(row.n) == {n for w, n in words if row.t is not None and w in row.t}


def test_words_that_begin_other_words_and_go_on_branching(spark):
    words = [("a" * n, n) for n in range(1, 120)] + [("é😀", 200), ("é", 201), (".b", 202), ("b]", 203)]
    texts = ["a" * 100, "x" + "a" * 50 + "b]", "é😀.b", "😀é", "aaé" + "a" * 200, ".]", None, ""]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words_found(F.col("t"), words).alias("n"))
    for row in made.collect():
        assert set(row.n) == {n for w, n in words if row.t is not None and w in row.t}


def test_the_walk_through_a_text_is_linear(spark):
    """A million characters: looking each place up from the start of the text takes minutes."""
    text = "bab nod lip x" * 80_000
    words = [(f"{a}{b}{c}", i) for i, (a, b, c) in enumerate((a, b, c) for a in "bnlx" for b in "aoi" for c in "bdpn")]
    made = spark.createDataFrame([(text,)], "t string").select(words_found(F.col("t"), words).alias("n"))
    began = time.time()
    assert set(made.first().n) == {n for w, n in words if w in text}
    assert time.time() - began < 30


def test_constant_texts(spark):
    assert spark.range(1).select(constant_texts(ODD)).first()[0] == ODD


def test_rules_of_an_ingest_may_be_many(spark):
    project_rules, description_rules = random_rules(7, 400)
    many = Rules(project_tags=project_rules, description_tags=description_rules, no_tag="NONE")
    made = spark.createDataFrame([("zzz", "zzz", "No"), ("abc", "gag", "Yes")], "project string, description string, billable string")
    tags = {r.project: r.type for r in tag_entries(clean_entries(made, many), many).collect()}
    assert tags["zzz"] == ["NONE"] and tags["abc"] != ["NONE"]
