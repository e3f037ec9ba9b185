"""Evidence-backed quality assessment of links, as Spark DataFrame operators."""
