"""brindle: a document and corpus analytics engine made of Spark DataFrame transformations."""
