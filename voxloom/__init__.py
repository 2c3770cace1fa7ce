"""voxloom: preparation of training data for voice and text models with PySpark.

``functions`` holds Column expressions, ``operators`` DataFrame operators,
``sources``/``streaming`` scans, sinks and incremental ingest, ``plans`` the
composed data paths and the registered queries.
"""

__version__ = "0.1.0"
