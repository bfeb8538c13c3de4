"""Share-event logs to per-ticker sentiment signals and tested return classifiers, on Spark."""
