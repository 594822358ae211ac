"""supportlake: customer-support conversation analytics as Spark DataFrame
transforms, Spark ML pipelines and Structured Streaming jobs."""

__version__ = "0.1.0"
