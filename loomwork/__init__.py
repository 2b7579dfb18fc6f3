"""Workspace, version-control and text analytics as DataFrame-to-DataFrame operators on Spark."""
