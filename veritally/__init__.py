"""veritally: reliability analytics over streams of answered events, on Spark."""
