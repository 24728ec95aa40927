"""Part of brindle; see README.md."""
