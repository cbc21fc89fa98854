"""cuesift: PySpark-native semantic search over timed captions, and the operators around it."""
