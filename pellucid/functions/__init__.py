"""Column functions that stay in the JVM, and numpy kernels for pixel planes."""
