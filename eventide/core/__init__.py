"""Building blocks shared by every operator: blocked series, ranks, checks."""
