"""Labels written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The full-width letters and the plain ones they stand for.
FULL_LETTERS = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
PLAIN_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def clean_label(x: Column) -> Column:
    """A label without letter case, width and outer blanks; null where nothing is left."""
    y = F.lower(F.trim(F.translate(F.regexp_replace(x, r"[\x{A0}\x{2000}-\x{200F}\x{3000}\x{FEFF}\t\r\n]", " "), FULL_LETTERS, PLAIN_LETTERS)))
    return F.when(F.length(y) > 0, y)
