"""Tables: a catalog of versions, stores that change them, and readers and writers of files."""
