"""keyfold: consolidate messy tables that describe the same business records, on Spark."""

from keyfold.model import Sheet

__all__ = ["Sheet"]
__version__ = "0.1.0"
