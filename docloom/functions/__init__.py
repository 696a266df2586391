"""functions of the document engine."""
