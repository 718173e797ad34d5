"""Fundamental equity research as Spark jobs: panels, screens, valuations, citations and evaluation."""
