"""souk: catalogue analytics as DataFrame-to-DataFrame operators on Spark."""
