"""Column expressions: geometry, labels, text, scores, and image kernels."""
