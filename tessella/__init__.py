"""tessella: a Spark-first engine for course-quality analytics and text pipelines."""
