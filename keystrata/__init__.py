"""keystrata: versioned key-value data as declarative PySpark queries.

The input is an ordered change log of puts and deletes.  Everything else - current state, point and range
reads, snapshots, sorted runs, compaction, change feeds, histories, incremental loads - is a DataFrame query
over that log, planned by Catalyst.
"""

__version__ = "0.1.0"
