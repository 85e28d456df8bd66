"""Questions in plain language to wire queries, by a pluggable model."""
