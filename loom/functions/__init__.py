"""Shared building blocks: one-pass statistics, exact order statistics, hash ranks, running sums."""
