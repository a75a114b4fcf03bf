"""SQL dialects: what they can do, their text forms, and column types across engines."""
