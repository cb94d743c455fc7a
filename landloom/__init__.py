"""landloom: land, sensor and corpus analytics as PySpark jobs."""
