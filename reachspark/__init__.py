"""River-reach raster and flow analytics as Spark DataFrame functions.

A raster is a table of cells ``(r, c, value)``; a stack of model results adds the discharge
``q``. Every public function takes DataFrames and plain parameters and returns a DataFrame.
"""

__version__ = "0.1.0"
