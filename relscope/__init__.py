"""relscope: relational profiling, checking and restructuring as Spark jobs."""
