"""Column functions on tensors and vectorised kernels."""
