"""Timeline features, leakage-safe encoders, exact metrics and prediction blending on Spark."""
