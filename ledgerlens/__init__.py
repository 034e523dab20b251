"""ledgerlens: customer and payments analytics as PySpark DataFrame jobs.

Subpackages: ``functions`` (column rules and dates), ``operators`` (the jobs),
``sources`` (readers and writers), ``streaming`` (incremental batch loads),
``plans`` (end-to-end jobs, fixtures and the registered queries).
"""

__version__ = "0.1.0"
