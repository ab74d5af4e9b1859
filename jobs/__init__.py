"""Runnable jobs: each module is a command line over one function that takes a session."""
