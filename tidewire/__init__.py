"""Message-log analytics on Spark: points, routing, lifecycle, snapshots, jobs and policies."""

__version__ = "0.1.0"
