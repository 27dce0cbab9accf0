"""Column expressions; none of them starts a job or needs a shuffle."""
