"""Registered queries of the engine's own operators, each with its SQL."""
