"""docsheaf: Spark-native review analytics over document, page, cell, check and finding tables."""
