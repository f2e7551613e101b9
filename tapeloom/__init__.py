"""Spark jobs for media transcription pipelines and streak analytics over whole tables and streams."""
