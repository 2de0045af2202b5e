"""Part of wakeflow; see README.md."""
