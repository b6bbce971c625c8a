"""Configuration and whole pipelines."""
