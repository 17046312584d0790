"""Subpackage of the vessel-movement engine."""
