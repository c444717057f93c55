"""Column-expression builders. Every function returns a ``Column``."""

from farelens.functions.bands import equal_width_bin, right_closed_band
from farelens.functions.dates import date_parts, season_name, season_code
from farelens.functions.lookups import lookup
from farelens.functions.money import cents, mean_from_cents

__all__ = [
    "equal_width_bin", "right_closed_band", "date_parts", "season_name", "season_code",
    "lookup", "cents", "mean_from_cents",
]
