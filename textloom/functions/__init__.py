"""Part of textloom; see README.md."""
