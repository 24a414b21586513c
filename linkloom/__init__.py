"""linkloom: record linkage and corpus preparation as Spark plans."""
