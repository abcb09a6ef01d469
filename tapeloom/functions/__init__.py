"""Scalar functions of the feeds as Spark columns, with driver-side twins where a literal is needed."""
