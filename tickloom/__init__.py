"""tickloom: Spark DataFrame operators and jobs for session-keyed, time-ordered data."""
