"""Pixelloom: Spark jobs over very large pixel-edit logs, and corpus operators in `pixelloom.llm`."""
