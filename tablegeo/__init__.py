"""Tables from positioned words, and their repair, as Spark DataFrame plans."""
