"""Column profiles, personal-data findings, anomalies, cadence, scores, diffs and redaction of tables, on Spark."""
