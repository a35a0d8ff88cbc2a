"""NumPy kernels that run inside one task for one group; no Spark here."""
