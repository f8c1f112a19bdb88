"""Column expressions and Arrow kernels used by the operators."""
