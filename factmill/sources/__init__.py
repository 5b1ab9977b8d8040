"""Reading and writing: JSON lines, manifests, counter tables."""
