"""Rule tables and what they compile to: columns and whole pipelines."""
