"""End-to-end plans: stand-in inputs derived from the driver tables, the three
data paths, and the query registry used by ``__spark_entry__``."""
