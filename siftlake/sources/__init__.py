"""siftlake.sources package."""
