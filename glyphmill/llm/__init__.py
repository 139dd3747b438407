"""Training-data pipeline operators. Nothing outside this subpackage imports it, save the guard in ``__spark_entry__.py``."""
