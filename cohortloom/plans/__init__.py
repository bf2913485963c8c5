"""The monthly marts and studies, assembled from the operators."""
