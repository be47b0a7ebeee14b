"""Part of tessera; see the modules of this package."""
