"""Column helpers and pure Python kernels used inside Arrow batches."""
