"""Plans of several steps: traversals and graph algorithms."""
