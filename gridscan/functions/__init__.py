"""Column expressions and native-aggregate helpers."""
