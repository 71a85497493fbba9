"""prefmill: preference data for code models, built and measured as Spark jobs.

functions   column expressions (and the few Arrow UDFs)
operators   DataFrame -> DataFrame building blocks
sources     readers and writers
plans       the operators joined into whole jobs
streaming   the same row-wise operators run on arriving files
"""

__version__ = "0.1.0"
