"""quillspark: filing analytics and corpus preparation expressed as Spark DataFrame programs."""
