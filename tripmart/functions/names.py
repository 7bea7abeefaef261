"""Name parsing for monthly files and raw tables.

The patterns are anchored: a sample table such as ``trips_green_2019_01_tiny``
or the unified ``trips_all`` never parses as a month.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of

# The services and the two naming conventions of the source.
SERVICES = ("yellow", "green")
# raw table per month: TRIPS_<SERVICE>_<YYYY>_<MM>
TABLE_PATTERN = r"(?i)^trips_(yellow|green)_(\d{4})_(\d{2})$"
# monthly file: <service>_tripdata_<YYYY>-<MM>.parquet (a file or a folder)
FILE_PATTERN = r"(?i)(?:^|/)(yellow|green)_tripdata_(\d{4})-(\d{2})(?:\.parquet)?(?:/|$)"
FILE_UNIT_PATTERN = r"(?i)^(.*/(?:yellow|green)_tripdata_\d{4}-\d{2}(?:\.parquet)?)(?:/.*)?$"


def extract_int(s, pattern: str, group: int) -> Column:
    """``TRY_TO_NUMBER(REGEXP_SUBSTR(s, pattern, ..., group))``; no match -> NULL."""
    return F.nullif(F.regexp_extract(col_of(s), pattern, group), F.lit("")).try_cast("int")


def extract_str(s, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(col_of(s), pattern, group), F.lit(""))


def split_part_int(s, delim: str, part: int) -> Column:
    """``TRY_TO_NUMBER(SPLIT_PART(s, delim, part))``."""
    return F.split_part(col_of(s), F.lit(delim), F.lit(part)).try_cast("int")


def month2(m) -> Column:
    """F16: two-digit month text, 1 -> '01'."""
    return F.lpad(col_of(m).cast("string"), 2, "0")


def table_name(service, year, month) -> Column:
    """``TRIPS_<SERVICE>_<YYYY>_<MM>`` (F15 upper)."""
    return F.concat_ws("_", F.lit("TRIPS"), F.upper(col_of(service)),
                       col_of(year).cast("string"), month2(month))


def file_name(service, year, month) -> Column:
    """``<service>_tripdata_<YYYY>-<MM>.parquet`` (F15 lower)."""
    return F.concat(F.lower(col_of(service)), F.lit("_tripdata_"),
                    col_of(year).cast("string"), F.lit("-"), month2(month),
                    F.lit(".parquet"))
