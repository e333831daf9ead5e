"""Spark jobs over large collections of small categorical grids, and over training text."""
