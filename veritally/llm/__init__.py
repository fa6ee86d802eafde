"""Operations of a training-data pipeline: dedup, decontamination, filters, extraction and mixing."""
