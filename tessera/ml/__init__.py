"""Model evaluation, out-of-fold prediction, calibration and ensembling over Spark ML estimators."""
