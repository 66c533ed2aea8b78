"""Column expressions: dates, arrays, histograms, entropy."""
