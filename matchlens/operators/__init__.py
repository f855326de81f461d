"""DataFrame to DataFrame operators over the match tables."""
