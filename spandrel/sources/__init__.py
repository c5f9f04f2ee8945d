"""Where payloads and frames come from and go to: files with their attributes, and in-memory bytes."""
