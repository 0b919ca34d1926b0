"""PySpark toolkit for security-by-day panels: loading, event studies, factors, reports."""
