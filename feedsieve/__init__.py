"""feedsieve: Spark jobs that curate archives and streams of short articles."""
