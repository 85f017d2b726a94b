"""Column functions: text to amounts, dates, header roles and rule scores."""
