"""Names, addresses, timestamps and lines as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .contact import INVISIBLE

#: Every line end that text may have, and formats of timestamps in the order they are tried (fixed values).
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"
TIMESTAMP_FORMATS = [
    "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "M/d/yyyy H:m:s", "M/d/yyyy H:m",
    "M-d-yyyy h:mm:ss a", "M-d-yyyy h:mm a", "M-d-yyyy H:m:s", "M-d-yyyy H:m",
    "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy/M/d H:m:s",
]


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalisation, which has no built-in; apply it to distinct names."""
    return s.fillna("").str.normalize("NFKC")


def norm_name(normalised: Column) -> Column:
    """The key of a display name that is NFKC already: letters, digits and underscores of any script in lower case."""
    kept = F.regexp_replace(F.lower(F.trim(normalised)), "[^\\p{L}\\p{N}_\\s\\x{A0}]", " ")
    return F.trim(F.regexp_replace(kept, "[\\s\\x{A0}]+", " "))


def clean_display_name(raw: Column) -> Column:
    """Without invisible characters and registration numbers, each run of letters with a capital."""
    s = F.regexp_replace(F.coalesce(raw, F.lit("")), INVISIBLE, "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "^\\s*[0-9]{6,}_+", ""), "\\s+", " "))
    runs = F.regexp_extract_all(s, F.lit("(\\p{L}+|\\P{L}+)"), F.lit(1))
    return F.when(F.upper(s) == F.lower(s), s).otherwise(F.array_join(F.transform(runs, F.initcap), ""))


def clean_email(raw: Column) -> Column:
    """Lower case and trimmed, or empty where it doesn't have the shape of an address."""
    e = F.rtrim(F.lower(F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), INVISIBLE, ""))), F.lit(".,;:"))
    e = F.regexp_replace(e, "\\s+", "")
    return F.when(e.rlike("^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"), e).otherwise("")


def parse_timestamp(raw: Column) -> Column:
    """A timestamp without zone, month before day; null where no format fits."""
    s = F.trim(F.coalesce(raw, F.lit("")), F.lit(" \t\""))
    tried = [F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in TIMESTAMP_FORMATS]
    return F.when(~s.isin("", "-", "--"), F.coalesce(*tried))


#: What counts as white space, as the inside of a character class.
BLANK = "\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x85\\x1C-\\x1F"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def round_tenth(x: Column) -> Column:
    """To one decimal as the binary value lies: only what is exactly between two goes to the even one.

    A decimal that ends in 5 is a tie in print only; the exact side is told by a product that splits the value in two halves.
    """

    def rounded(d: Column) -> Column:
        printed = d.cast("decimal(30,12)")
        tenths = F.floor(printed * 10).cast("long")
        tie = printed * 20 == (2 * tenths + 1)
        high = d.cast("float").cast("double")
        above = (2 * tenths + 1).cast("double") - 20 * high - 20 * (d - high)  # positive below the tie
        up = F.when(above < 0, 1).when(above > 0, 0).otherwise(F.abs(tenths % 2).cast("int"))
        return F.when(tie, (tenths + up) / F.lit(10.0)).otherwise(F.round(printed, 1).cast("double"))

    return F.element_at(F.transform(F.array(x.cast("double")), rounded), 1)


def second_of_day(clock: Column) -> Column:
    part = lambda k: F.split_part(clock, F.lit(":"), F.lit(k)).cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def decode_bytes(content: Column) -> Column:
    """Text of a file: UTF-16 by its mark, else UTF-8 with damage replaced."""
    mark = F.substring(content, 1, 2)
    wide = mark.isin(bytearray(b"\xff\xfe"), bytearray(b"\xfe\xff"))
    text = F.when(wide, F.decode(content, "UTF-16")).otherwise(F.make_valid_utf8(content.cast("string")))
    return F.regexp_replace(text, "^\\x{FEFF}", "")


def lines(text: Column) -> Column:
    """The lines of a text, without an empty one after the last line end."""
    found = F.split(text, LINE_END)
    last = (F.element_at(found, -1) == "").cast("int")
    return F.slice(found, F.lit(1), F.size(found) - last)
