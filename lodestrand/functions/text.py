"""Text cleaning shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of Unicode's White_Space property and the four separators U+001C to U+001F.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Words that stand for a missing id or scaffold, in lower case.
PLACEHOLDERS = ("nan", "none", "null", "na", "n/a", "<na>", "no_scaffold", "missing", "unknown")


def stripped(c: Column) -> Column:
    """Without outer blanks of any kind; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def present(c: Column, placeholders: tuple[str, ...] = ()) -> Column:
    """Without outer blanks; null where nothing, or only a placeholder word, is left."""
    s = stripped(c)
    gone = s == ""
    if placeholders:
        gone = gone | F.lower(s).isin(*placeholders)
    return F.when(~gone, s)


def key(c: Column) -> Column:
    """An id for comparison: without outer blanks and case; null where missing."""
    return F.upper(present(c, PLACEHOLDERS))
