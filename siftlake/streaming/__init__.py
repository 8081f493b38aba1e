"""siftlake.streaming package."""
