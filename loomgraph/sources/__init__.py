"""Source trees, diffs, configuration and symbol extraction."""
