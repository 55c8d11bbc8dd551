"""Operators combined into whole runs."""
