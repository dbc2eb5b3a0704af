"""inkwell: research-corpus analytics expressed as Spark DataFrame plans."""
