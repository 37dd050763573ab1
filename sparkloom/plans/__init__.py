"""Configuration, durable intermediate results and whole pipelines."""
