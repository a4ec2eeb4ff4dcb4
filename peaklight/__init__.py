"""Search and signal processing for one-dimensional spectra, on Spark DataFrames."""
