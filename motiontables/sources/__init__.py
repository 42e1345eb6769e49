"""Readers and writers, and the motion views derived from generic warehouse tables."""
