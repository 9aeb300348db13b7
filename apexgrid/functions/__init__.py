from apexgrid.functions import scalar
from apexgrid.functions.channel import Ch, ch, derivative, integrate, smooth

__all__ = ["Ch", "ch", "derivative", "integrate", "scalar", "smooth"]
