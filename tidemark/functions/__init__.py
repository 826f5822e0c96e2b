"""Column expressions: text and keys, scores and labels, impact dimensions."""
