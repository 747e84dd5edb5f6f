"""The analysis planner and the end-to-end run."""
