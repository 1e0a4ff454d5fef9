"""Front ends: source files to facts, a file at a time in Arrow batches."""
