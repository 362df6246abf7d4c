"""Trajectory-dataset analytics on Spark: DataFrame-to-DataFrame operators over frames, episodes, tasks and statistics."""

__version__ = "0.1.0"
