"""Readers and writers. All paths go through Spark, so any store that Spark knows will do."""
