"""NumPy raster kernels that run inside Arrow UDFs, one image a row."""
