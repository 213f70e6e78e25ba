"""Part of tilewright; see README.md."""
