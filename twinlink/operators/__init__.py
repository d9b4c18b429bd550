"""DataFrame -> DataFrame operators over canonical pairs."""
