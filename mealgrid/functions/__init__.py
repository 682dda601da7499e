"""Column expressions: normalisation, parsing, labels and text building."""
