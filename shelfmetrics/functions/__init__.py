"""Column functions: units, ratings, phrases, JSON decoding and pack sizes."""
