"""The SQL front end: text to statements, statements to DataFrames."""
