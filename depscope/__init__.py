"""Spark jobs over source-code dependencies, agent activity and training text."""
