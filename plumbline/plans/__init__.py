"""Frames over the driver tables, composite jobs, the tool surface and the query catalog."""
