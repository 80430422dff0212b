"""Analysis operators: profile, generic steps, association, target-aware steps,
time series, clustering, features, baseline model."""
