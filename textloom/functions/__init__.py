"""Column functions: text normalisation, prompts, scores and vectors. All run inside Spark's own expressions."""
