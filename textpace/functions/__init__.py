"""Column expressions: text in, Column out. Nothing here triggers a job."""
