"""quillspar: source-evidence analytics and corpus preparation as Spark jobs."""
