"""Applications of the engine."""
