"""Sources (S1-S7), sinks (K1-K4) and the pair fixture built from the test tables."""
