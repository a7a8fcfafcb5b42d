"""Merchant table of the first classification layer.

The table itself is data: ``merchants.csv`` beside this module holds the fixed values of the
built-in one, as keyword, category, subcategory.
"""

from __future__ import annotations

import csv
from pathlib import Path

#: Built-in table; any other can be passed to ``munim.operators.classify`` instead.
MERCHANT_FILE = Path(__file__).with_name("merchants.csv")

# Names that only count as whole words (short alphabetic names always do).
WHOLE_WORD_MERCHANTS = [
    "ola", "nse", "bse", "igl", "mgl", "pvr", "kfc", "ccd", "oyo", "emi", "sip", "ppf",
    "nps", "fd",
]


def builtin_merchants() -> list[tuple[str, str, str]]:
    """(keyword, category, subcategory) of the built-in table."""
    with MERCHANT_FILE.open(encoding="utf-8", newline="") as f:
        return [(r["keyword"], r["category"], r["subcategory"]) for r in csv.DictReader(f)]
