"""Column-level helpers shared by every operator."""
