"""DataFrame operators over check points, labels, results and words."""
