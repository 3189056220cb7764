"""What the library itself keeps: tables in the shared folder, and vector indexes. Sources are never written."""
