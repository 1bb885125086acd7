"""Writers of tables, bundles and provenance."""
