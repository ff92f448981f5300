"""Whole experiments: a grid in one job, a suite run by run, and the sample jobs."""
