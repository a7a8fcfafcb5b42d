"""White space at the edges of cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: All characters that count as white space in Unicode, and the four separator controls.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(
    chr(c) for c in range(0x2000, 0x200B)) + "    　"


def strip(text: Column | str) -> Column:
    """Text without white space of any kind at both ends."""
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(BLANKS))
