"""Column expressions: text, dates, companies, places, titles, keys, numbers."""
