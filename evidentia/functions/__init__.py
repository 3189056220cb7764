"""Column expressions that the detectors are made of; nothing here runs Python on rows."""
