"""Training-data operators: ten corpus-curation components and the pipeline built on them."""
