"""foldline: catalogue, deduplication and folder-planning operators on Spark."""
