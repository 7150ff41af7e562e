"""Column expressions: text, URLs, places, times and HTML. They call no action."""
