"""siftlake.functions package."""
