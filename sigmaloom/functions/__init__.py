"""Column expressions. All of them are total: no input value raises, none drops a row."""
