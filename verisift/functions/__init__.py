"""Column-to-column functions; none of them starts a job or shuffles."""
