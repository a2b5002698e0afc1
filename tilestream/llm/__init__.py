"""Operators that a training-data pipeline needs beside the raster and stream engine.

Nothing else in the library imports this subpackage.
"""
