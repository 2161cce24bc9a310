"""linkloom: link, duplicate, orphan and training-data analytics as Spark DataFrame operators."""
