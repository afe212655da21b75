"""Operations of a training-data pipeline: scoring, filtering, deduplication, extraction, archives and mixing."""
