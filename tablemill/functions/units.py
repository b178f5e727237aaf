"""Connected-load units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kilowatts per unit of load.
KILOWATTS_PER_UNIT = {"KW": 1.0, "KVA": 0.9, "HP": 0.746, "BHP": 0.746}


def load_kilowatts(load: Column, unit: Column) -> Column:
    """Load in kW. ``load`` is a double; it is rounded half-even and counts as 0 if null."""
    whole = F.rint(F.coalesce(load, F.lit(0.0)))
    name = F.upper(F.trim(unit))
    factor = F.lit(None).cast("double")
    for code, kilowatts in KILOWATTS_PER_UNIT.items():
        factor = F.when(name == code, F.lit(kilowatts)).otherwise(factor)
    return whole * factor
