"""Column-level functions (native expressions; Arrow UDFs only where noted)."""
