"""Operations of a training-data pipeline on documents, lines, embeddings and conversations."""
