"""Software-weakness text and web-page security analytics as Spark DataFrame jobs."""
