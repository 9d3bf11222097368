"""A PySpark-native engine for hierarchical metadata: find, ls, du, statistics, histograms, outliers and diffs."""
