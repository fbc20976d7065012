"""Operators for preparing training data: clusters, canonical values, set joins, percentiles, packing, leaks, look-alikes."""
