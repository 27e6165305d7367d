"""Column expressions and the fixed values they rely on."""
