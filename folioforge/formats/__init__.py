"""Single-document parsers: bytes in, Markdown and title out. No Spark here."""
