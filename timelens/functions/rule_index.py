"""Large rule lists as constant tables that every entry looks up.

One expression a rule is fine for a few dozen rules. With thousands, planning and
generated code grow with the list and every entry tests all of them. Here the list is
one constant array of buckets. Exact pairs are looked up by a checksum of the pair. Words
that may stand anywhere in a text are found by one expression that branches by character
and goes through the text once, in time linear in its length; the distinct ones found are
looked up by their checksums.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Collection, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From this many rules on the tables are used.
INDEXED_FROM = 100
#: Words that branch more often than this are listed one by one where they still differ.
MOST_LEVELS = 40


def _buckets(number: int) -> int:
    return 1 << max(4, (2 * number).bit_length())


def _text(value: str) -> str:
    """A SQL literal of any text: characters that are not plain go by their numbers."""
    plain = (
        ch if ch.isascii() and (ch.isalnum() or ch in " -_.:") else f"\\U{ord(ch):08x}" for ch in value
    )
    return f"'{''.join(plain)}'"


def constant_texts(values: Sequence[str]) -> Column:
    """A constant array of texts."""
    return F.expr(f"array({', '.join(map(_text, values))})")


def _table(buckets: Sequence[Iterable[str]], fields: str) -> Column:
    """A constant array of arrays of structs; each element is given as SQL."""
    rows = ", ".join(f"array({', '.join(bucket)})" for bucket in buckets)
    return F.expr(f"CAST(array({rows}) AS array<array<struct<{fields}>>>)")


def _bucket(table: Column, key: Column, number: int) -> Column:
    return F.get(table, (F.crc32(key) % number).cast("int"))


def _pair(first: str, second: str) -> str:
    return f"{len(first)}:{first}{second}"


def pair_lookup(first: Column, second: Column, pairs: Sequence[tuple[str, str, str]]) -> Column:
    """The third text of the first rule whose pair equals the two columns, else null."""
    known: dict[str, str] = {}
    for a, b, result in pairs:
        known.setdefault(_pair(a, b), result)
    number = _buckets(len(known))
    buckets: list[list[str]] = [[] for _ in range(number)]
    for key, result in known.items():
        at = zlib.crc32(key.encode()) % number
        buckets[at].append(f"named_struct('key', {_text(key)}, 'result', {_text(result)})")
    key = F.concat(F.length(first).cast("string"), F.lit(":"), first, second)
    found = F.filter(_bucket(_table(buckets, "key:string,result:string"), key, number), lambda p: p["key"] == key)
    return F.get(found, 0)["result"]


def _quoted(text: str) -> str:
    return "".join(ch if ch.isascii() and ch.isalnum() else f"\\x{{{ord(ch):x}}}" for ch in text)


def _longest(words: Collection[str], level: int = 0) -> str:
    """A regular expression for the longest of the words that stands at a place.

    Words with the same beginning share a branch, so a place is tried once and not once
    a word. Words that go on branching for long are listed from there on.
    """
    ends = "?" if "" in words else ""
    rests: dict[str, list[str]] = {}
    for word in words:
        if word:
            rests.setdefault(word[0], []).append(word[1:])
    if not rests:
        return ""
    if level == MOST_LEVELS:
        listed = sorted(filter(None, words), key=len, reverse=True)
        return f"(?:{'|'.join(map(_quoted, listed))}){ends}"
    single = [first for first, rest in rests.items() if rest == [""]]
    branches = [f"[{''.join(map(_quoted, single))}]"] if single else []
    for first, rest in rests.items():
        if rest != [""]:
            shared = os.path.commonprefix(rest)
            after = _longest([word[len(shared) :] for word in rest], level + 1)
            branches.append(_quoted(first + shared) + after)
    return f"(?:{'|'.join(branches)}){ends}"


def words_found(text: Column, words: Sequence[tuple[str, int]]) -> Column:
    """The numbers that belong to the words that occur anywhere in the text, unordered.

    The result is an array that may have a number more than once; null texts have none.
    At every place the longest word is found; the others there are beginnings of it, so
    the table has their numbers under the longest one too.
    """
    numbers: dict[str, list[int]] = {}
    for word, number in words:
        numbers.setdefault(word, []).append(number)
    everywhere = [F.lit(number) for number in numbers.pop("", [])]
    none = F.array().cast("array<int>")
    found = F.when(text.isNotNull(), F.array(*everywhere)) if everywhere else none
    if numbers:
        size = _buckets(len(numbers))
        buckets: list[list[str]] = [[] for _ in range(size)]
        for word in numbers:
            at = zlib.crc32(word.encode()) % size
            for end in range(1, len(word) + 1):
                for number in numbers.get(word[:end], ()):
                    buckets[at].append(f"named_struct('word', {_text(word)}, 'rule', {number})")
        table = _table(buckets, "word:string,rule:int")
        seen = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({_longest(numbers)}))"), F.lit(1)))

        def rules_of(word: Column) -> Column:
            known = F.filter(_bucket(table, word, size), lambda w: w["word"] == word)
            return F.transform(known, lambda w: w["rule"])

        found = F.concat(found, F.coalesce(F.flatten(F.transform(seen, rules_of)), none))
    return F.coalesce(found, none)
