"""Day/night neighborhood analytics as Spark DataFrame jobs."""
