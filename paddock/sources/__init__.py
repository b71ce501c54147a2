"""Input tables: schemas, readers and the driver-table binding."""

from paddock.sources.tables import (
    PLACE_NAMES,
    PLACE_ROMAJI,
    RaceTables,
    master_place_df,
    read_jdbc_tables,
    read_tables,
    write_tables,
)
from paddock.sources.binding import bind_driver_tables

__all__ = [
    "PLACE_NAMES", "PLACE_ROMAJI", "RaceTables", "master_place_df", "read_jdbc_tables",
    "read_tables", "write_tables", "bind_driver_tables",
]
