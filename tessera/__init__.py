"""tessera: governed data movement, cleaning, matching and lineage on Spark DataFrames."""

__version__ = "0.1.0"
