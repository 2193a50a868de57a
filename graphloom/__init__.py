"""A Spark-native engine for RDF graph-pattern queries. Engine answers SPARQL over a Store or over tables."""
