"""DataFrame operators over document tables."""
