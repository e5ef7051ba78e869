"""Part of the tracewright engine."""
