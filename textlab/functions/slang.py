"""slang expansion.

``substring`` mode reproduces the reference literally: plain, case-sensitive
substring replacement, one key after the other in the table's order, each
pass seeing the output of the previous ones (so ``ur`` inside ``your`` is
replaced again).  ``token`` mode is the sane variant: whole whitespace tokens
are looked up in the table.  Both are plain column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlab.functions.clean import _c, lookup, split_ws
from textlab.functions.wordlists import slang_pairs


def expand_slang(col, mode: str = "substring", table=None) -> Column:
    pairs = table if table is not None else slang_pairs()
    if mode == "substring":
        c = _c(col)
        for key, value in pairs:
            c = F.replace(c, F.lit(key), F.lit(value))
        return c
    if mode == "token":
        m = dict(pairs)
        toks = F.transform(split_ws(col), lambda t: lookup(m, t, t))
        return F.array_join(toks, " ")
    raise ValueError(f"unknown mode {mode!r}")
