"""gridloom: a Spark-first engine for curating, clustering and evaluating observation runs."""
