"""Column expressions; nothing here triggers a job or a shuffle."""
