"""Building blocks shared by all operators: ranking, nesting, skew handling, merging."""
