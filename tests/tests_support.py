"""Small files that several tests read."""

from test_io import dark_square, tiff

__all__ = ["dark_square", "tiff"]
