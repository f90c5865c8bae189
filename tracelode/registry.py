"""Every query of the trace engine, by name, with the SQL it is held against."""

from .plans.oracles import ORACLES
from .plans.queries import QUERIES

FLAGSHIP = "occ_top"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
