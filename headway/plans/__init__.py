"""The catalogue: every query of the library by name, with its SQL where SQL can express it."""
