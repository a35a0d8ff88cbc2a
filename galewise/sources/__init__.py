"""Readers and writers, and the views that give the engine's tables from the driver's."""
