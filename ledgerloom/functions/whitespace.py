"""One definition of white space for the JVM, Python and SQL: the characters str.isspace() accepts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside a character class of Java's regular expressions.
JAVA = r"\u0009-\u000d\u001c-\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same for RE2 (DuckDB).
RE2 = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

WORD = re.compile(r"\S+")


def squeeze(c: str | Column) -> Column:
    """Runs of white space become one space, outer ones go."""
    return F.trim(F.regexp_replace(c, f"[{JAVA}]+", " "))


def word_count(c: str | Column) -> Column:
    """Runs of other characters; 0 for NULL."""
    bare = squeeze(c)
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, 0).otherwise(F.size(F.split(bare, " ")))
