"""Signal segmentation, scaling, alignment and models."""
