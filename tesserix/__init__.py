"""tesserix: PySpark-native sparse Bayesian regression and association analysis."""
