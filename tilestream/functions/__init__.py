"""Part of tilestream; see the README."""
