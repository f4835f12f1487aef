"""Runnable jobs: each is a function of a session and plain paths, and a command line around it."""
