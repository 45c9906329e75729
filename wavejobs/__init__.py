"""Spark jobs for fleets of acoustic flow meters, and a set of corpus operators."""
