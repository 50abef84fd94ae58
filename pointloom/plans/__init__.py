"""Views of the driver's tables and the registered query plans."""
