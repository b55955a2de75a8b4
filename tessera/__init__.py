"""Tessera: compound-table analytics and corpus preparation as Spark jobs."""
