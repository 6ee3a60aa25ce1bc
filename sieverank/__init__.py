"""sieverank: DataFrame operators that parse, match, score and rank profile records on Spark."""
