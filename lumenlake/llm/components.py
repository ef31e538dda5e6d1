"""Components and joins that hot keys don't slow down, as the library has them."""

from lumenlake.operators.components import HOT, components, joined

__all__ = ["HOT", "components", "joined"]
