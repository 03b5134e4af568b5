"""parley: conversation analytics as Spark jobs over tables of timed speech."""
