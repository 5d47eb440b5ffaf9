"""Collections fed by streams."""
