"""Sources and sinks."""

from .fixture import raw_from_events, raw_transactions  # noqa: F401
from .raw import read_raw_csv, read_raw_parquet  # noqa: F401
from .sinks import create_view, write_table  # noqa: F401
