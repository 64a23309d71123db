"""Part of diffloom."""
