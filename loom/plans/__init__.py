"""Registered queries (catalog), end-to-end case-study flows (recipes) and plan inspection."""
