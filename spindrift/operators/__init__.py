"""Operators over events: matching, window pruning, versions and statistics."""
