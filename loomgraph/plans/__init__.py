"""Plans: views, queries and pipelines composed of operators."""
