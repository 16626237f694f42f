"""Training-data operators: decontamination, deduplication, quality, packing.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; ``queries`` holds the registered queries and
``oracles`` the SQL they are compared with.

Python code that runs on executors is imported from this package by name, so
a cluster needs the package on the executors' path (``--py-files``).
"""
