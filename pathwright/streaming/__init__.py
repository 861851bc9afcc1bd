"""Counts over rollouts as they arrive."""
