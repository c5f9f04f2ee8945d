"""Query catalogue and configuration."""
