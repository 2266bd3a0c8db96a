"""Column expressions: coercion, phones, texts and reasons."""
