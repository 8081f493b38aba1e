"""siftlake.plans package."""
