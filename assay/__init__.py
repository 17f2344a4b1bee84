"""Evidence analytics and corpus preparation on Spark."""
