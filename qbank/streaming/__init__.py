"""Change capture and publishing, in batch and as streams."""
