"""Column expressions: text, validators, numbers and dates, anonymisation. Nothing here runs Python on executors."""
