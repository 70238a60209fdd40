"""gridscan: large rasters as Spark tables.

Pixels, tiles, labels and context grids are DataFrames; every operator takes and returns DataFrames and
stays lazy.  See README.md for the map of modules.
"""
