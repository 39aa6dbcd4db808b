"""Profiling, preparation, training and scoring of labelled tables on Spark."""
