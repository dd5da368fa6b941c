"""Layered raster images as relations: pixels, tiles, masks and strokes as DataFrames."""
