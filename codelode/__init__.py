"""codelode: analytics over source code, notes and their graph, written as Spark jobs."""
