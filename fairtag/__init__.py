"""fairtag: marketplace price intelligence as PySpark DataFrame operators."""

from fairtag.params import Params

__all__ = ["Params"]
