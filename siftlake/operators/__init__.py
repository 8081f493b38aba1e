"""siftlake.operators package."""
