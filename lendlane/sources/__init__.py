"""Table schemas, readers, the golden dimensions and the fixture views."""
