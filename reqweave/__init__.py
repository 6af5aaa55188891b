"""Reqweave: requirement tables from technical documents, as Spark plans."""
