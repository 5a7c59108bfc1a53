"""Series frames, segmentation of long series, and end-to-end workflows."""
