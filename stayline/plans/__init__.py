"""The four workloads, each from input tables to its results."""
