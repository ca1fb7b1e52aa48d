"""Text splitting with the line and blank definitions of the rule files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that end a line, and characters that count as blank
# at either end of a line.
LINE_BREAKS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def lines(text: Column) -> Column:
    """Array of the lines of a text, not stripped, blanks included."""
    return F.split(text, LINE_BREAKS)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))
