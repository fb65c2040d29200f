"""The three complete workloads."""
