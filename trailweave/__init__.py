"""trailweave: coverage analytics of decision graphs and run traces on Spark."""
