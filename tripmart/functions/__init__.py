"""Scalar Column expressions; all built-in Spark functions, no UDFs."""

from .casts import code_key, to_float, to_number, to_timestamp_ntz, to_varchar, typed_null
from .names import (FILE_PATTERN, TABLE_PATTERN, extract_int, extract_str, file_name,
                    month2, split_part_int, table_name)
from .ratio import iff, round_to, speed_mph, tip_pct
from .time import (boundary_diff, date_of, day_name, hour_of, is_weekend,
                   minutes_between, seconds_between)

__all__ = [
    "boundary_diff", "code_key", "date_of", "day_name", "extract_int",
    "extract_str", "file_name", "FILE_PATTERN", "hour_of", "iff", "is_weekend",
    "minutes_between", "month2", "round_to", "seconds_between", "speed_mph",
    "split_part_int", "table_name", "TABLE_PATTERN", "tip_pct", "to_float", "to_number",
    "to_timestamp_ntz", "to_varchar", "typed_null",
]
