"""Lodestone: agent-trace analytics and corpus operators on Spark."""
