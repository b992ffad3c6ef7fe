from gleaner.sources.readers import (
    category_paths,
    inventory_digest,
    read_interactions,
    read_metadata,
    read_reviews,
    read_table,
    source_inventory,
)
from gleaner.sources.schemas import METADATA_SCHEMA, REVIEW_SCHEMA
from gleaner.sources.writers import save_results, write_by_year, write_table

__all__ = [
    "METADATA_SCHEMA", "REVIEW_SCHEMA", "category_paths", "inventory_digest", "read_interactions",
    "read_metadata", "read_reviews", "read_table", "save_results", "source_inventory",
    "write_by_year", "write_table",
]
