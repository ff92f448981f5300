"""Readers and writers: datasets, archives, configuration files, logs, host lists, run tables."""
