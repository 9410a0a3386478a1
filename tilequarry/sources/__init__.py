"""Reading tables, manifests and annotation files."""
