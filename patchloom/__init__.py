"""A PySpark engine for sampling training patches from very large pyramidal images."""
